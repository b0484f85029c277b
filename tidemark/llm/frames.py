"""What the corpus operators share: row ids, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import run_dir

ROW = "struct<file: bigint, row: bigint>"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def with_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with an id for each row that is the same whenever the row is read again.

    Rows of files are named by file and position. Any other input is numbered by partition,
    which is the same again as long as its partitions are.
    """
    try:
        place = F.struct(
            F.xxhash64(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.row_index").cast("bigint").alias("row"),
        )
        out = df.select("*", place.alias(name))
        out.schema  # noqa: B018  (resolves the plan)
        return out
    except AnalysisException:
        number = F.monotonically_increasing_id()
        return df.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("file"), number.alias("row")))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or, if ``df`` has such a column, a longer one (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``df`` without the rows that ``verdicts`` (``_row, kept``) drops.

    The rows are joined by their ids, which are all different, so no task has more than its
    share whatever the texts are.
    """
    name = free_name(df, "_row")
    dropped = verdicts.filter("NOT kept").select(F.col("_row").alias(name))
    return with_rows(df, name).join(dropped, name, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def keep(df: DataFrame, name: str, layout: tuple[str, ...] = (), **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and there after lost executors.
    ``layout`` names columns that become folders, ``options`` those of the file format."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.options(**options).partitionBy(*layout).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table of :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_text(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in batches of ``BATCH_BYTES``, unless the session has a
    setting of its own. Both sides hold a batch at a time, so large ones are memory that an
    executor never gives back; results do not depend on it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time. Memory
    goes back to the system at the end of the task."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()
