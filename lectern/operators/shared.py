"""Tables that several steps read and that must be the same to each of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder named by ``spark.checkpoint.dir`` that nothing else uses. Where the setting is empty, on one machine, a new temporary folder is used."""
    folder = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(SETTING, folder)
    return f"{folder.rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` as written once, as Parquet, to the shared folder; its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of what a session has made once, by session, name and the files it was made from.
_made: dict[tuple, str] = {}


def once(df: DataFrame, name: str, make: Callable[[str], object]) -> str:
    """The folder in which ``make`` has put what it makes from ``df``: made anew for each session, and when a file of ``df`` has changed."""
    spark = df.sparkSession
    jvm, files = spark._jvm, []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, hash(tuple(files)))
    if key in _made:
        path = jvm.org.apache.hadoop.fs.Path(_made[key])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return _made[key]
    folder = new_folder(spark, name)
    make(folder)
    _made[key] = folder
    return folder


#: Bytes of text that a task takes up at once.
SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SLICE_BYTES`` of text, a longer text alone, so that what is made of texts stays small whatever a batch holds."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    number = (sizes.cumsum() - sizes) // SLICE_BYTES
    cuts = [0, *((number[1:] != number[:-1]).nonzero()[0] + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)
