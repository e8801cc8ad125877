"""Shared pieces of the text operators: shared-folder tables and clean inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    In local mode an unset value is replaced by a temporary folder; on a cluster
    an unset value is an error, because a machine-local folder would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="rillframe-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder's owner cleans it then
            return


class Workspace:
    """Tables written to the shared folder to cut lineage; readable after an executor is lost."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _made.append((spark, self.root))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


#: Rows and bytes of an Arrow batch: texts reach hundreds of kilobytes, so a batch of Spark's default
#: 10,000 rows would fill a small executor several times over.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) in small batches; other columns are left out, so their names can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def give_back() -> None:
    """Freed memory to the system: a Python worker keeps what its earlier tasks and steps have freed, beside the JVM's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def row_binaries(column) -> list[memoryview]:
    """Zero-copy views of an Arrow binary or string column; a null gives an empty view."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        return [v for chunk in column.chunks for v in row_binaries(chunk)]
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    import numpy as np

    _, offsets, data = column.buffers()
    n, start = len(column), column.offset
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, start * (8 if wide else 4)).tolist() if n else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    out = [view[a:b] for a, b in zip(off, off[1:])]
    if column.null_count:
        out = [v if ok else memoryview(b"") for v, ok in zip(out, column.is_valid().to_pylist())]
    return out
