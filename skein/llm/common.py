"""What the operators share: the folder that all executors see, written tables, joins with a checked broadcast, batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast up to so many rows of a few numbers each; a larger side is shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of text that a Python worker holds at once beside the Arrow batch itself.
CHUNK_BYTES = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"skein-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict = {}


def remembered(key, make: Callable):
    """What make gives, made once for a key in a Python worker, which goes from task to task. Only the last key's is kept, so that a
    worker does not carry what other operators needed."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def kept_rows(docs: DataFrame, keep: Callable[[list], list[bool]], name: str = "text") -> DataFrame:
    """The rows of docs for which keep says so, given their texts in batches; all columns as they are, without a shuffle."""
    at = docs.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may clash
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already
            return


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts right only if it was counted and has few rows; else both sides are shuffled and Spark splits hot keys."""
    few = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if few else right, on, how)


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """A column under its own name and type. A name that differs only in case or has dots does not clash."""
    return df[f"`{name}`"].cast(kind).alias(name)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most so many bytes together, or one row."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start)
