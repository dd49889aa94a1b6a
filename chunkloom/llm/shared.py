"""What the operators of this subpackage share: storage that all executors see, and Arrow helpers.

Intermediate tables go below ``spark.checkpoint.dir`` as read from the session, or the context's checkpoint folder. Only where
neither is set and Spark runs in one process, as in tests, a folder is made and set; on a cluster that raises.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='chunkloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table outlives lost executors. It goes when the driver ends, for lazy results may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may have gone first; the folder is temporary anyway
            return


def rowwise(df: DataFrame, columns: list[str], schema: pa.Schema, work: Callable[[list[list]], list[list]], sql_schema: str) -> DataFrame:
    """Map ``columns`` of each Arrow batch, given as lists, to output columns. Map only: no shuffle."""
    return df.select(*columns).mapInArrow(mapper(work, schema), sql_schema)


def mapper(work: Callable[[list[list]], list[list]], schema: pa.Schema, rows: int = 500):
    """Slices of at most ``rows`` rows bound what Python holds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = work([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, which bounds what is turned into Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
