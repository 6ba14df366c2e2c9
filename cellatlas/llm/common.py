"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batches, hashed samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: One word, as a regular expression that Java and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Words whose CRC-32 of the id leaves 0 here are held out of all training.
FOLDS = 5

#: Scratch paths that still exist, with the name of the table over each, if it has one.
_scratch: dict[str, str | None] = {}
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where that is unset and one machine runs all (tests)."""
    global _local_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="checkpoints-")
    return _local_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellatlas-{uuid.uuid4().hex}-{name}"
    with _moved_once(spark):
        df.select("*").write.parquet(path)
    _scratch[path] = None
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`stored`, dealt into buckets by ``key``: joins on it do not move these rows again.

    The rows should be dealt by the key already, or be few to a task: every task writes a file for each bucket that it has rows of."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    path, table_name = f"{shared_dir(spark)}/cellatlas-{mark}-{name}", f"cellatlas_{mark}"
    with _moved_once(spark):
        df.select("*").write.option("path", path).bucketBy(buckets, key).saveAsTable(table_name)
    _scratch[path] = table_name
    back = spark.table(table_name)
    back._scratch_path = path
    return back


@contextmanager
def _moved_once(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write as soon as it ends, and not when the driver happens to collect its garbage.

    This holds for frames that are made inside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def release(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by :func:`stored` once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._scratch_path)


def collect_garbage(spark: SparkSession) -> None:
    """Spark removes the shuffle files of plans that nothing refers to any more when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory(spark: SparkSession) -> None:
    """Executors give the heap that finished work has left back to the machine; they keep it otherwise, though most of it is free.

    One small task for each core: where all are idle, every executor gets some."""
    collect_garbage(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def scratch_paths() -> set[str]:
    return set(_scratch)


def release_paths(spark: SparkSession, paths: set[str]) -> None:
    """Deletes these scratch tables; for callers that have stored what was built on them."""
    for path in paths:
        _delete(spark, path)
    release_memory(spark)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _scratch:
        name = _scratch.pop(path)
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; what it has freed goes back to the machine, as idle Python workers stay for a while."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def with_columns(df: DataFrame, run: Callable[[dict[str, list]], dict[str, list]], added: str, keep: tuple[str, ...] = ("doc_id",), start: Callable | None = None) -> DataFrame:
    """The ``keep`` columns of ``df`` as they are, and new ones that ``run`` makes from lists of the others, row by row.

    Kept columns stay in Arrow, so that ids of any type, nulls among them, come out unchanged. ``start`` makes, once a
    task, what ``run`` gets as its second argument."""
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields[len(keep) :]]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for b in rows:
            given = {c: b.column(c).to_pylist() for c in b.schema.names if c not in keep}
            made = run(given, *state)
            columns = [b.column(c).cast(arrow.field(c).type) for c in keep] + [pa.array(made[c], arrow.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(trimmed(batches), schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get so many rows, and about 8 MB, at a time from the plans run inside, which bounds their memory over long texts."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


#: Bytes that are broadcast at most.
MAX_BROADCAST = 32 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if its measured size allows it; beyond, joins shuffle it."""
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= MAX_BROADCAST else df


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def share_below(key: Column, share: float, seed: int) -> Column:
    """A seeded hash sample: true for about ``share`` of the keys, the same keys on every run."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
