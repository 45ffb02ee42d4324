"""Where the operators of this subpackage keep tables that several stages read.

All intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and every executor share, so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the setting is empty (tests on one machine) a new temporary folder is used and kept for the session."""
    jvm_conf = spark.sparkContext.getConf()
    found = jvm_conf.get(SETTING) or spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(SETTING, found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read from there: its lineage ends at the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`kept` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lectern/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a bit map, as a power of two: 512 KB.
MAP_BITS = 22
_LONGS = (1 << MAP_BITS) // 64


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Which values the top ``MAP_BITS`` bits of the longs in ``hash`` take. At most ``_LONGS`` rows come to the driver, whatever the table's size."""
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))")
    longs = np.zeros(_LONGS, np.int64)
    for at, value in hashes.select(F.shiftrightunsigned(place, 6).alias("long"), bit.alias("bit")).groupBy("long").agg(F.bit_or("bit")).collect():
        longs[at] = value
    return longs.view(np.uint8)


def held_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the bit map may hold."""
    place = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def parted(rows: DataFrame, hash_: Column, table: DataFrame, table_hash: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose hash is surely not among the table's, and those where it may be.

    The table's hashes go into a bit map of fixed size (``_LONGS`` rows at most), which is
    broadcast. So the first part, and all its texts, stay where they are; only the second has
    to be joined with the table. A full bit map costs a shuffle, not a row.
    """
    place = lambda h: F.shiftrightunsigned(h, 64 - MAP_BITS)
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = kept(table.select(place(table_hash).alias("_place")).groupBy(F.shiftrightunsigned("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "bit-map")
    marked = rows.withColumn("_place", place(hash_)).withColumn("_word", F.shiftrightunsigned("_place", 6)).join(F.broadcast(words), "_word", "left")
    held = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(~held).drop("_place", "_word", "_bits"), marked.where(held).drop("_place", "_word", "_bits")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
