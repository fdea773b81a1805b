"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eraloom.session import table_dir


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file lies; callers may pass another path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: str | Column, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``parts``; -1 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts)), F.lit(-1)).cast("int")


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by the hash of ``key``; all of them if there are fewer.

    The choice depends on the key only, so a recomputed task gives the same
    rows. Used to fit models on a bounded number of labelled rows.
    """
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * 2**30)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(2**30)) < share)


@contextmanager
def collector_off() -> Iterator[None]:
    """No garbage collection by Python's own count meanwhile; Spark gives the worker to later stages, so it is on again afterwards.

    What there is before, mostly modules, is left out of collections asked for meanwhile: looking through it takes longer than a small batch leaves to find.
    """
    gc.disable()
    gc.freeze()
    try:
        yield
    finally:
        gc.unfreeze()
        gc.enable()


# Functions of a Python worker whose results are kept from task to task by ``lru_cache``.
_kept: list = []


def forgettable(cached) -> None:
    """Have :func:`forget` clear the ``lru_cache`` of ``cached``."""
    _kept.append(cached)


def forget() -> None:
    """Give back what other stages' functions keep in this Python worker; Spark hands workers from stage to stage.

    Only what was kept is collected, since a collection looks through all objects of the worker.
    """
    full = [cached for cached in _kept if cached.cache_info().currsize]
    for cached in full:
        cached.cache_clear()
    if full:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While something is written, hand Python at most ``rows`` rows at a time, so that batches of long texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_file(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Write ``data`` below ``spark.checkpoint.dir`` and hand it to every executor; its ``SparkFiles`` name.

    Executors, also those that start later, fetch their own copy, which tasks
    can map into memory. ``data`` must be of bounded size.
    """
    name = f"{uuid.uuid4().hex}{suffix}"
    where = f"{table_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(data), 1 << 22):
        stream.write(bytearray(data[at : at + (1 << 22)]))
    stream.close()
    spark.sparkContext.addFile(where)
    return name


def columns_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns of the caller never clash."""
    return df.select(*[F.col(n) for n in names])
