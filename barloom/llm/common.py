"""Shared pieces of the corpus operators: tables, materialisation, byte-level text views.

Texts are looked at as the UTF-8 bytes of an Arrow column, many documents at a time.
``TextBlock`` holds one slice of such a column (about four MB, or one longer document)
and finds words, lines and word hashes for all of its documents with numpy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Slices of the pipeline's stages: their workers run all five, beside a JVM whose heap has grown to its limit.
STAGE_BYTES = 1 << 20
DEALT_MB = 16
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than the cluster has cores, dealt anew so that all of them have work; any other as it is.

    Small is less than ``DEALT_MB`` a core by the plan's own estimate: larger files have splits enough, and no
    large table is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(estimate) < (cores * DEALT_MB) << 20 and 0 < len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode our own if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage: a lost executor costs a reread of files, never a recomputation. rows: about how many
    there are, for narrow rows right after a shuffle; they go to a file for each ``FILE_ROWS``, one for each core
    at least. Without that a small table has as many files as the shuffle has partitions, and on local disks
    the executor's JVM starts several processes for each file.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that clashing or extra columns never reach an operator."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class TextBlock:
    """Bytes of some whole documents, back to back, and where each begins."""

    def __init__(self, array: pa.Array):
        array = array.fill_null("")
        if array.type != pa.large_string():
            array = array.cast(pa.large_string())
        n = len(array)
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
        data = array.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = n

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where ``inside`` holds; no run crosses documents."""
        return runs_of(inside, self.offsets)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the document that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(inside)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1]
    edge = edge[edge < size]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:] - 1
    edge = edge[edge >= 0]
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes that separate words: blank and 0x09 to 0x0D.
SPACE = _byte_table(b" \t\n\v\f\r")
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX = np.random.default_rng(20240817).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Callable[[np.uint64, int], np.ndarray] = powers) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes anywhere."""
    with np.errstate(over="ignore"):
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_MIX[data] * powers(_BASE, n), out=sums[1:])
        out = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
        return mix(out + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` bytes of text; a longer document stands alone."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply a function to slices of (doc_id, text) batches; ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, limit):
                out = work(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast ``value`` in a form that holds its classes, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over all of its tasks."""
    import sys
    import types

    return sys.modules.setdefault("_barloom_worker_cache", types.ModuleType("_barloom_worker_cache")).__dict__.setdefault("store", {})
