"""What the corpus operators share: tables, staging in the cluster's shared folder, and batch handling."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer text is handled alone.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Where it is unset, a folder of this machine if all of Spark runs here, in
    one process; elsewhere a ValueError, since other machines couldn't read what is written there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="tracewright-")
        context.setCheckpointDir(found)
    return found


#: Folders of staged tables, in the order in which they were written.
_places: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage is cut and no executor's disk is relied on."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(place)
    _places.append(place)
    atexit.register(remove, spark, place)
    return spark.read.schema(df.schema).parquet(place)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table staged; all that was staged on the way to it is removed."""
    before = len(_places)
    out = staged(make())
    for place in _places[before:-1]:
        remove(out.sparkSession, place)
    del _places[before:-1]
    return out


def remove(spark: SparkSession, place: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be over; the folder belongs to it
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def text_spans(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about step bytes each, a longer row alone."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > step:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(column):
        yield start, len(column)


def strings(column: pa.Array) -> pa.Array:
    """A string column with 32-bit offsets and null as the empty text."""
    return column.cast(pa.string()).fill_null("")


def by_text(batches: Iterator[pa.RecordBatch], column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """work on slices of the batches that hold about step bytes of text each."""
    for batch in batches:
        if batch.num_rows:
            for start, stop in text_spans(strings(batch.column(column)), step):
                yield work(batch.slice(start, stop - start))
