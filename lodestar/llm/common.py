"""What the operators of this subpackage share: the shared scratch folder, checked broadcasts, row locators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.utils import AnalysisException

#: A side is broadcast only when it has been counted and holds no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 32 << 20
#: What goes to a Python worker at once, the rows that a scan decodes at once, and the bytes of a stored table's row groups.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS, GROUP_BYTES = 1000, "2m", 512, 32 << 20

_fallback: tempfile.TemporaryDirectory | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine (tests)."""
    global _fallback
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = tempfile.TemporaryDirectory(prefix="lodestar-")
        atexit.register(_fallback.cleanup)
    return "file://" + _fallback.name


def small_batches(spark: SparkSession) -> None:
    """Hold what goes to a Python worker at once to BATCH_ROWS rows and BATCH_BYTES, however long texts are, unless the session has less.

    Scans decode SCAN_ROWS at once, else texts make arrays of tens of megabytes, for which a heap grows and stays large.
    """
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > SCAN_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and afterwards what its task held goes back to the system: Python workers live on, and would keep it."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder. What lies there is needed until the result that reads it has been used."""
    small_batches(spark)
    return f"{shared_dir(spark)}/lodestar/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes are within the limits; else df, and the join shuffles. rows: how many there are, if known."""
    if rows is not None and rows > limit:
        return df
    of = lambda f: F.octet_length(f.name) if isinstance(f.dataType, StringType | BinaryType) else 16 * F.size(f.name) if isinstance(f.dataType, ArrayType) else F.lit(0)
    size = sum((F.coalesce(of(f), F.lit(0)) + 16 for f in df.schema), F.lit(0).cast("long"))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if n <= limit and (total or 0) <= most else df


def crc32_bucket(col: str, n: int) -> Column:
    """crc32 of a column's text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def located(docs: DataFrame) -> DataFrame:
    """docs with _file and _row, which together name each row. What isn't a plain file scan is stored once, so that names last."""
    try:
        return docs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        held = stored(docs, "rows")
        return held.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
