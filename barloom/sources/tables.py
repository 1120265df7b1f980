"""Readers and writers: Parquet, bar CSV, raw minute CSV, JSON configuration, run history."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = "ts_event timestamp, open double, high double, low double, close double, volume long, symbol string"
BAR_SCHEMA = "time long, open double, high double, low double, close double, volume long"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_raw_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Minute export, columns by name; a .zst, .gz or .bz2 suffix picks the codec (for .zst see ``read_zstd_minutes``)."""
    return spark.read.option("header", True).schema(RAW_SCHEMA).csv(path)


def read_zstd_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Minute exports in zstd files, for clusters whose Hadoop has no native zstd: a file is decompressed as a stream in one task."""

    def run(batches):
        import io

        import zstandard

        for batch in batches:
            for raw in batch.column(0):
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw.as_py()), read_across_frames=True), "utf-8")
                head = text.readline().rstrip("\r\n")
                while lines := text.readlines(1 << 20):
                    yield pa.record_batch([pa.array([head] * len(lines)), pa.array([x.rstrip("\r\n") for x in lines])], names=["head", "line"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "head string, line string")
    names, fields = F.split("head", ","), F.split("line", ",")

    def value(name: str, kind: str):
        return F.get(fields, F.array_position(names, F.lit(name)).cast("int") - 1).try_cast(kind).alias(name)

    return rows.select(*[value(*part.split(" ")) for part in RAW_SCHEMA.split(", ")])


def bar_times(bars: DataFrame, time: str = "time") -> DataFrame:
    """Unix times to ``ts`` (UTC): milliseconds if the value is over 1e12, else seconds."""
    t = F.col(time)
    ts = F.when(t > 10**12, F.timestamp_millis(t)).otherwise(F.timestamp_seconds(t))
    return bars.withColumn("ts", F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))).drop(time)


def read_bars(spark: SparkSession, path: str, symbol: str = "ALL") -> DataFrame:
    """Canonical bar CSV to (symbol, ts, open, high, low, close, volume)."""
    return bar_times(spark.read.option("header", True).schema(BAR_SCHEMA).csv(path)).select(F.lit(symbol).alias("symbol"), "ts", "open", "high", "low", "close", "volume")


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Parquet, CSV or JSON sink, partitioned by ``by``."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.format(form).option("header", True).save(path)


def newest_config(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """The JSON configuration whose file name sorts last."""
    rows = spark.read.option("multiLine", multi_line).json(pattern).withColumn("__file", F.input_file_name())
    last = rows.agg(F.max("__file").alias("__file"))
    return rows.join(F.broadcast(last), "__file").drop("__file")


def run_history(runs: DataFrame, keep: int = 5, run: str = "run_id") -> DataFrame:
    """Rows of the ``keep`` newest runs, with ``age`` 0 for the latest."""
    names = runs.select(run).distinct().withColumn("age", F.dense_rank().over(Window.orderBy(F.desc(run))) - 1).where(F.col("age") < keep)
    return runs.join(F.broadcast(names), run)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table, without its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def record_run(runs: DataFrame, path: str, keep: int = 5, run: str = "run_id") -> list[str]:
    """Append runs to a history partitioned by ``run``; folders of all but the ``keep`` newest go. Gives the names kept.

    Names are compared as text. Folders are few (``keep`` and those just written).
    """
    runs.write.mode("append").partitionBy(run).parquet(path)
    hadoop = runs.sparkSession._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(runs.sparkSession._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()), reverse=True)
    names = [n for n in names if n.startswith(f"{run}=")]
    for old in names[keep:]:
        files.delete(hadoop.Path(folder, old), True)
    return [n.split("=", 1)[1] for n in names[:keep]]


def write_model(model, path: str) -> str:
    """Save a fitted model; gives the digest of what was stored."""
    model.write().overwrite().save(path)
    return model_checksum(model, path)


def model_checksum(model, path: str) -> str:
    """Digest of a stored model: the kind of model and the bytes of its data files, whatever their names."""
    spark = SparkSession.getActiveSession()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    parts = files.select(F.sha2("content", 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]
    return f"{type(model).__name__}-{parts[:32]}"


def read_model(kind, path: str, expected: str | None = None):
    """Load a model of class ``kind``; a digest other than ``expected`` is refused."""
    model = kind.load(path)
    if expected is not None and model_checksum(model, path) != expected:
        raise ValueError(f"the model at {path} is not the one that was recorded")
    return model


def checksum(df: DataFrame) -> str:
    """Order-free digest of a table, for registries of models and data."""
    row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("s")).first()
    return f"{row['n'] & 0xFFFFFFFF:08x}{(row['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}{(row['s'] or 0) & 0xFFFFFFFF:08x}"


def title_case(df: DataFrame) -> DataFrame:
    """Columns renamed the way canonical files are loaded: open -> Open."""
    return df.toDF(*[c.title() if re.fullmatch(r"open|high|low|close|volume", c, re.I) else c for c in df.columns])


def has_type(df: DataFrame, column: str, kind: type[T.DataType]) -> bool:
    return isinstance(df.schema[column].dataType, kind)
