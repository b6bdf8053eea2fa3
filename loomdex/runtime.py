"""Scratch tables in the folder that all machines share, and shipping this package to executors."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import io
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_left: dict[str, SparkSession] = {}
_lock = threading.Lock()
#: Bytes of rows in a batch for Python, unless the session sets another number: batches are bounded by size, however long texts are.
BATCH_BYTES = 8 << 20
#: Bytes of text that a Python worker turns into numpy arrays at a time.
BLOCK_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or, where that is unset and all runs in one process (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        with _lock:
            found = getattr(spark.sparkContext, "_loomdex_shared", None)
            if not found:
                if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
                found = "file://" + tempfile.mkdtemp(prefix="loomdex-")
                spark.sparkContext._loomdex_shared = found
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, so that they need no install of it, and bound the session's Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    with _lock:
        if getattr(sc, "_loomdex_shipped", False):
            return
        top = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        path = os.path.join(tempfile.mkdtemp(prefix="loomdex-code-"), "loomdex_code.zip")
        Path(path).write_bytes(data.getvalue())
        sc.addPyFile(path)
        sc._loomdex_shipped = True


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the Hadoop API for a path in any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
    _left.pop(path, None)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_left.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its owner clears the shared folder
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loomdex/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and lets AQE split skewed joins on it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomdex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote for tables that nothing reads any more, such as a loop's earlier rounds."""
    for t in tables:
        if path := getattr(t, "_loomdex_path", None):
            remove(t.sparkSession, path)


def arrow_udf(schema: str, make=F.pandas_udf):
    """A pandas UDF made at its first use: the module can then be imported without a session, as executors do.

    It counts as non-deterministic, so that the optimizer neither repeats it for each field of its result nor moves it.
    """

    def wrap(f):
        made = []

        @functools.wraps(f)
        def use(*columns):
            if not made:
                made.append(make(f, schema).asNondeterministic())
            return made[0](*columns)

        return use

    return wrap


def flat_udf(schema: str):
    """The same over Arrow arrays, without Python objects for their values."""
    return arrow_udf(schema, F.arrow_udf)


def text_blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES):
    """Slices of a batch of about `most` text bytes; a longer text has a slice of its own. Between slices Arrow's free memory goes back to the system."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(arr), 0))
    at, n = 0, len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def _trim() -> None:
    """Give free memory of this process back to the system, as far as its allocators can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(each):
    """A map over batches whose worker, which later tasks use again, starts and ends without the free memory of what ran in it."""

    @functools.wraps(each)
    def run(batches):
        _trim()
        try:
            yield from each(batches)
        finally:
            _trim()

    return run
