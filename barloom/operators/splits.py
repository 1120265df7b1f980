"""Cross-validation splits as tables: (split_id, row_id, role), role ``train`` or ``test``.

Rows come as (row_id, t0, t1): positions from 0, and the label's span; a missing t1 means
t0. Test blocks are few rows against the data, so they travel to the rows: purging and embargo are
searches in an index of blocks, never a join of rows with rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import by_symbol


def numbered(rows: DataFrame, t0: str = "ts", t1: str | None = None) -> DataFrame:
    """(symbol, row_id, t0, t1) of one series or of many."""
    return rows.select("symbol", (F.row_number().over(by_symbol()) - 1).alias("row_id"), F.col(t0).alias("t0"), (F.coalesce(F.col(t1), F.col(t0)) if t1 else F.col(t0)).alias("t1"))


def index_problems(rows: DataFrame) -> DataFrame:
    """Counts that are 0 for a valid index: null or repeated times, spans that end before they begin."""
    return rows.agg(F.count_if(F.col("t0").isNull()).alias("n_null"), (F.count("t0") - F.count_distinct("t0")).alias("n_repeated"), F.count_if(F.col("t1") < F.col("t0")).alias("n_backward"))


def embargo_size(n: int, embargo: int | float) -> int:
    """Bars, or a fraction in [0, 1) of n, rounded up."""
    if isinstance(embargo, bool) or not isinstance(embargo, (int, float)):
        raise TypeError("an embargo is a number of bars or a fraction")
    if embargo < 0 or (isinstance(embargo, float) and embargo >= 1):
        raise ValueError("an embargo is at least 0, and a fraction under 1")
    return math.ceil(n * embargo) if isinstance(embargo, float) else embargo


def folds(rows: DataFrame, k: int) -> DataFrame:
    """Add ``fold`` 0..k-1: contiguous, the first n mod k one row longer (the sizes of ntile, from a count)."""
    n = rows.agg(F.count("*").alias("__n"))
    size, more = F.floor(F.col("__n") / k), F.col("__n") % k
    edge = (size + 1) * more
    fold = F.when(F.col("row_id") < edge, F.floor(F.col("row_id") / (size + 1))).otherwise(more + F.floor((F.col("row_id") - edge) / F.greatest(size, F.lit(1))))
    return rows.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("__n")


def bounds(tests: DataFrame, keys: tuple[str, ...] = ("split_id",)) -> DataFrame:
    """Hull of each test set: first and last row, least t0, greatest t1."""
    return tests.groupBy(*keys).agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.min("t0").alias("from_t"), F.max("t1").alias("to_t"))


def overlaps(t0: Column, t1: Column, from_t: Column, to_t: Column) -> Column:
    return (t0 <= to_t) & (t1 >= from_t)


def blocks_of(tests: DataFrame) -> DataFrame:
    """(split_id, block): contiguous runs of test rows with their bounds."""
    order = Window.partitionBy("split_id").orderBy("row_id")
    runs = tests.withColumn("block", F.col("row_id") - F.row_number().over(order))
    return bounds(runs, ("split_id", "block"))


SENT = 1_000_000  # blocks that are sent to the rows at once: 40 bytes each


def _whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Times or numbers as whole numbers, in the column's own unit."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else _whole(column.combine_chunks())


def purged(rows: DataFrame, tests: DataFrame, embargo: int = 0, hull: bool = True, purge: bool = True, each_block: bool = True) -> DataFrame:
    """Splits from test sets (split_id, row_id, t0, t1).

    hull: purge against the whole span from a split's first test start to its last test
    end; else against each contiguous block. each_block: the embargo follows every block,
    else only the last test row.

    Test blocks become an index for each split, which goes to the rows: block starts in order with the
    largest end so far, found by binary search. A row overlaps a block if, of the blocks that
    begin by its own end, the largest end reaches its start. So a row costs a few searches a split,
    however many blocks there are, and nothing is shuffled. Splits go in groups of ``SENT``
    blocks (a split's own blocks are sent together).
    """
    found = blocks_of(tests).select("split_id", "first_row", "last_row", "from_t", "to_t")
    n_blocks = {r["split_id"]: r["n"] for r in found.groupBy("split_id").agg(F.count("*").alias("n")).collect()}  # a row a split
    groups: list[list[int]] = [[]]
    for split in sorted(n_blocks):
        if groups[-1] and sum(n_blocks[s] for s in groups[-1]) + n_blocks[split] > SENT:
            groups.append([])
        groups[-1].append(split)
    plain = rows.select("row_id", "t0", "t1")
    schema = T.StructType([tests.schema["split_id"], plain.schema["row_id"], T.StructField("role", T.StringType())])
    return reduce(DataFrame.union, [_by_index(plain, found.where(F.col("split_id").isin(g)) if len(groups) > 1 else found, schema, embargo, hull, purge, each_block) for g in groups])


def _by_index(plain: DataFrame, blocks: DataFrame, schema: T.StructType, embargo: int, hull: bool, purge: bool, each_block: bool) -> DataFrame:
    held = blocks.toArrow()
    split, first, last, begin, end = (_whole(held.column(c)) for c in ("split_id", "first_row", "last_row", "from_t", "to_t"))
    index = []
    for s in np.unique(split).tolist():
        own = np.flatnonzero(split == s)
        own = own[np.argsort(first[own], kind="stable")]
        order = own[np.argsort(begin[own], kind="stable")]
        starts, ends = begin[order], np.maximum.accumulate(end[order])
        if hull:
            starts, ends = starts[:1], ends[-1:]
        index.append((s, first[own], last[own], starts, ends, last[own] if each_block else last[own].max(keepdims=True)))
    sent = plain.sparkSession.sparkContext.broadcast(index)
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32() for f in schema.fields[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, t0, t1 = (_whole(batch.column(i)) for i in range(3))
            for s, first, last, starts, ends, after in sent.value:
                at = np.searchsorted(first, row, side="right") - 1
                test = (at >= 0) & (row <= last[at])
                out = np.zeros(len(row), bool)
                if purge:
                    at = np.searchsorted(starts, t1, side="right") - 1
                    out |= (at >= 0) & (ends[at] >= t0)
                if embargo:
                    at = np.searchsorted(after, row, side="left") - 1
                    out |= (at >= 0) & (row <= after[at] + embargo)
                kept = np.flatnonzero(test | ~out)
                yield pa.record_batch([pa.array(np.full(len(kept), s), kinds[0]), pa.array(row[kept], kinds[1]), pa.array(np.where(test[kept], "test", "train"))], names=["split_id", "row_id", "role"])

    return plain.mapInArrow(run, schema)


def purged_kfold(rows: DataFrame, k: int = 5, embargo: int | float = 0, purge: bool = True) -> DataFrame:
    """k contiguous test folds, training rows purged of overlapping spans, an embargo after the fold."""
    n = rows.count()
    tests = folds(rows, k).withColumnRenamed("fold", "split_id")
    return purged(rows, tests, embargo_size(n, embargo), True, purge)


def combinatorial(rows: DataFrame, n_folds: int = 6, n_test: int = 2, embargo: int | float = 0, hull: bool = True) -> DataFrame:
    """All choices of ``n_test`` of the folds as test sets. The hull purge takes away everything between two folds; ``hull=False`` purges block by block."""
    n = rows.count()
    chosen = [(i, f) for i, combo in enumerate(itertools.combinations(range(n_folds), n_test)) for f in combo]
    combos = rows.sparkSession.createDataFrame(chosen, "split_id int, fold int")
    tests = folds(rows, n_folds).join(F.broadcast(combos), "fold").drop("fold")
    return purged(rows, tests, embargo_size(n, embargo), hull)


def assign_blocks(counts: list[dict], sizes: list[int], k: int) -> list[int]:
    """Fold of each block: the first k round robin, then wherever counts and size come closest to their share; the lowest fold on ties."""
    groups = sorted({g for c in counts for g in c}, key=str)
    target = {g: sum(c.get(g, 0) for c in counts) / k for g in groups}
    share = sum(sizes) / k
    held, held_size, out = [dict.fromkeys(groups, 0) for _ in range(k)], [0] * k, []
    for b, (c, size) in enumerate(zip(counts, sizes, strict=True)):
        def miss(f: int, c=c, size=size) -> float:
            return sum((held[f][g] + c.get(g, 0) - target[g]) ** 2 for g in groups) + (held_size[f] + size - share) ** 2

        f = b if b < k else min(range(k), key=miss)
        for g, v in c.items():
            held[f][g] += v
        held_size[f] += size
        out.append(f)
    return out


def clustered(rows: DataFrame, cluster: str, k: int = 5, blocks_per_split: int = 4, least: int = 1, embargo: int | float = 0, purge: bool = True) -> DataFrame:
    """Folds of contiguous blocks that balance cluster counts. Only block counts (tens of rows) reach the driver."""
    n = rows.count()
    size = max(least, math.ceil(n / (k * blocks_per_split)))
    blocked = rows.withColumn("block", F.floor(F.col("row_id") / size).cast("int"))
    found = blocked.groupBy("block", cluster).count().collect()
    n_blocks = max((r["block"] for r in found), default=-1) + 1
    counts = [{r[cluster]: r["count"] for r in found if r["block"] == b} for b in range(n_blocks)]
    fold = assign_blocks(counts, [sum(c.values()) for c in counts], k)
    table = rows.sparkSession.createDataFrame(list(enumerate(fold)), "block int, split_id int")
    tests = blocked.join(F.broadcast(table), "block").drop("block", cluster)
    return purged(rows.drop(cluster), tests, embargo_size(n, embargo), False, purge)


def _windows(rows: DataFrame, windows: list[tuple[int, int, int, int]]) -> DataFrame:
    """Broadcast (split_id, train_from, train_to, test_to) to the rows; ends are exclusive, test begins at train_to."""
    table = rows.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(windows)], "split_id int, train_from long, train_to long, test_from long, test_to long")
    return rows.crossJoin(F.broadcast(table))


def rolling_windows(n: int, train: int, test: int, step: int | None = None) -> list[tuple[int, int, int, int]]:
    step = step or test
    return [(a, a + train, a + train, a + train + test) for a in range(0, n - train - test + 1, step)]


def walk_forward_windows(n: int, train: int, test: int, step: int | None = None, expanding: bool = False) -> list[tuple[int, int, int, int]]:
    return [(0 if expanding else a, b, c, d) for a, b, c, d in rolling_windows(n, train, test, step)]


def n_rolling(n: int, train: int, test: int, step: int | None = None) -> int:
    return len(rolling_windows(n, train, test, step))


def walk_forward(rows: DataFrame, train: int, test: int, step: int | None = None, expanding: bool = False, purge: bool = False, embargo: int = 0, parity: bool = False) -> DataFrame:
    """Rolling or expanding windows. ``parity`` with expanding and purge doesn't restrict training to before the test, as the published form has it."""
    n = rows.count()
    windows = walk_forward_windows(n, train, test, step, expanding)
    if not windows:
        return rows.sparkSession.createDataFrame([], "split_id int, row_id long, role string")
    every = _windows(rows.select(F.col("row_id").cast("long").alias("row_id"), "t0", "t1"), windows)
    r = F.col("row_id")
    is_test = (r >= F.col("test_from")) & (r < F.col("test_to"))
    in_train = (~is_test if parity and expanding and purge else (r >= F.col("train_from")) & (r < F.col("train_to")))
    if purge:
        spans = every.where(is_test).groupBy("split_id").agg(F.min("t0").alias("from_t"), F.max("t1").alias("to_t"))
        every = every.join(F.broadcast(spans), "split_id")
        in_train = in_train & ~overlaps(F.col("t0"), F.col("t1"), F.col("from_t"), F.col("to_t"))
    if embargo:
        in_train = in_train & ~((r >= F.col("test_to")) & (r < F.col("test_to") + embargo))
    return every.withColumn("role", F.when(is_test, "test").when(in_train, "train")).where("role is not null").select("split_id", "row_id", "role")


def grouped_time(rows: DataFrame, k: int = 5, period: str = "day") -> DataFrame:
    """Test folds of whole days, weeks or months, dealt like ntile over the sorted periods; all others train."""
    stamped = rows.withColumn("__p", F.date_trunc(period, F.col("t0").cast("timestamp")))
    periods = stamped.select("__p").distinct().withColumn("split_id", F.ntile(k).over(Window.orderBy("__p")) - 1)
    every = stamped.join(F.broadcast(periods.withColumnRenamed("split_id", "own")), "__p").crossJoin(F.broadcast(periods.select("split_id").distinct()))
    return every.select("split_id", "row_id", F.when(F.col("own") == F.col("split_id"), "test").otherwise("train").alias("role"))


def adaptive_embargo(rows: DataFrame, tests: DataFrame, vol: str = "vol", scale: float = 2.0, w: int = 50) -> DataFrame:
    """(split_id, row_id) under an embargo on both sides of each test block, as long as ceil(scale * vol / rolling median vol) at its most.

    Missing volatility takes the last value known, or the next one; the median needs one value.
    """
    order = Window.orderBy("row_id") if "symbol" not in rows.columns else Window.partitionBy("symbol").orderBy("row_id")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    filled = rows.withColumn("__v", F.coalesce(F.last(vol, True).over(past), F.first(vol, True).over(ahead)))
    typical = F.percentile("__v", F.lit(0.5)).over(order.rowsBetween(-(w - 1), 0))
    sized = filled.withColumn("len", F.greatest(F.coalesce(F.ceil(scale * F.try_divide("__v", F.nullif(typical, F.lit(0.0)))), F.lit(0)), F.lit(0)))
    runs = tests.withColumn("block", F.col("row_id") - F.row_number().over(Window.partitionBy("split_id").orderBy("row_id")))
    blocks = runs.join(sized.select("row_id", "len"), "row_id").groupBy("split_id", "block").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.max("len").alias("len"))
    reach = F.broadcast(blocks.where("len > 0"))
    marked = rows.select("row_id").join(reach, (F.col("row_id") >= F.col("a") - F.col("len")) & (F.col("row_id") <= F.col("b") + F.col("len"))).select("split_id", "row_id").distinct()
    return marked.join(tests.select("split_id", "row_id"), ["split_id", "row_id"], "left_anti")


def audit(splits: DataFrame, rows: DataFrame, strict: bool = False, label: str | None = None) -> DataFrame:
    """One row a split: sizes, shared rows, and training spans that overlap the test hull.

    Parity takes the hull up to the last test start; ``strict`` up to the last test end.
    With a label, the class counts of both sides come as maps.
    """
    joined = splits.join(rows, "row_id")
    tests = joined.where("role = 'test'")
    hull = F.broadcast(tests.groupBy("split_id").agg(F.min("t0").alias("from_t"), F.max("t1" if strict else "t0").alias("to_t")))
    train = joined.where("role = 'train'").join(hull, "split_id")
    clash = train.groupBy("split_id").agg(F.count("*").alias("n_train"), F.count_if(overlaps(F.col("t0"), F.col("t1"), F.col("from_t"), F.col("to_t"))).alias("n_overlap"))
    shared = splits.groupBy("split_id", "row_id").agg(F.count_distinct("role").alias("k")).groupBy("split_id").agg(F.count_if(F.col("k") > 1).alias("n_shared"))
    out = tests.groupBy("split_id").agg(F.count("*").alias("n_test")).join(clash, "split_id", "left").join(shared, "split_id").na.fill(0, ["n_train", "n_overlap"])
    if label:
        counts = joined.groupBy("split_id", "role", label).count().groupBy("split_id").agg(*[
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(F.col(label).cast("string"), "count"))))).alias(f"{role}_classes") for role in ("train", "test")
        ])
        out = out.join(counts, "split_id")
    return out.withColumn("leaks", (F.col("n_overlap") > 0) | (F.col("n_shared") > 0))


def summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split_id").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"), F.min(F.when(F.col("role") == "test", F.col("row_id"))).alias("test_from"), F.max(F.when(F.col("role") == "test", F.col("row_id"))).alias("test_to"))


def timeline(splits: DataFrame) -> DataFrame:
    """Contiguous stretches of each role in each split: what a split chart draws."""
    order = Window.partitionBy("split_id", "role").orderBy("row_id")
    runs = splits.withColumn("run", F.col("row_id") - F.row_number().over(order))
    return runs.groupBy("split_id", "role", "run").agg(F.min("row_id").alias("from_row"), F.max("row_id").alias("to_row")).drop("run")


def as_pairs(splits: DataFrame) -> Iterable[tuple[int, DataFrame, DataFrame]]:
    """(split_id, train rows, test rows) for loops over models; the ids are a handful."""
    for row in splits.select("split_id").distinct().orderBy("split_id").collect():
        one = splits.where(F.col("split_id") == row["split_id"])
        yield row["split_id"], one.where("role = 'train'").select("row_id"), one.where("role = 'test'").select("row_id")
