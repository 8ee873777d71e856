"""Shared helpers: whole-text Arrow mapping, shared-folder checkpoints, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handed to a Python kernel at once; bounds worker memory for long texts.
SLICE_ROWS = 256

#: The bytes that separate words in the ``[0-9a-z and beyond ASCII]`` word rule, and A-Z lowered.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the named columns, whatever else the input holds; null text becomes empty."""
    return df.select(
        F.col(id_col).cast("long").alias(id_col),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *(F.col(c) for c in more),
    )


def map_slices(
    df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]]], schema: str | StructType,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``mapInArrow`` with a kernel built once per task and fed slices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = kernel()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/sparkloom-checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: a lost executor recomputes nothing before this."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Spool:
    """Intermediate Parquet tables in the shared folder, removed together once they are no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(column: Column) -> Column:
    """Lower A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))
