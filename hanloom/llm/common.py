"""Shared folder, written tables and worker state for the training-data operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Bytes of a batch between the JVM and a worker.
BATCH = 4 << 20


_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this process, on a local master only:
    on a cluster the setting is needed."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hanloom-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query inside has shuffled goes from disk as the query ends. It would else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Workspace:
    """Tables written to the shared folder. They cut lineage: what an executor loses is read again, not computed again. Operators remove what
    they alone have read; what a result still reads stays until ``remove``, or the end of ``temporary``."""

    #: For each ``temporary`` that is open, the workspaces made since.
    _open: ClassVar[list[list[Workspace]]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/hanloom-{name}-{uuid.uuid4().hex}"
        for made in self._open:
            made.append(self)

    @classmethod
    @contextmanager
    def temporary(cls) -> Iterator[None]:
        """Workspaces made inside are removed at the end, when what was computed from them has been written elsewhere."""
        cls._open.append([])
        try:
            yield
        finally:
            for made in cls._open.pop():
                made.remove()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def remove(self, *tables: str) -> None:
        """The named tables, or all."""
        for table in tables or ("",):
            self._remove(table)

    def _remove(self, table: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow``, with batches of about BATCH bytes unless the session sets a size: rows of text are long, and both the JVM and the
    worker hold a batch whole."""
    if df.sparkSession.conf.get(_ARROW, None) is None:
        df.sparkSession.conf.set(_ARROW, str(BATCH))
    return df.mapInArrow(run, schema)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    name = "_hanloom_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def once(key: object, make: Callable[[], object]) -> object:
    state = worker_state()
    if key not in state:
        state[key] = make()
    return state[key]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def free_name(base: str, columns: list[str]) -> str:
    """``base`` with as many underscores before it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts add up to about ``limit`` characters; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes, whole rows, so that what a worker holds is bounded by that or its
    longest row."""
    for b in batches:
        n = max(1, b.num_rows * limit // max(limit, b.nbytes))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def trim() -> None:
    """Gives free memory back to the system: a worker would else keep the most it has held. Without effect where the C library can't."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def squeeze(a: np.ndarray) -> bytes:
    """Counts in the least width that holds them, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w)
    raw = a.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def spread(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], size, "zstd", asbytes=True) if size else b"", f"<u{b[0]}").astype(np.int64)
