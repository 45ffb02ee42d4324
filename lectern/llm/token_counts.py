"""Token counts with a digest cache.

A text's digest is taken after white space is made uniform, which the tokenizer drops anyway;
the tokenizer's digest covers its file and this encoder's version. Counts are stored by both
digests. A run joins its texts' digests to the store before any text moves, encodes each
distinct miss once and appends it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .storage import kept, parted
from .workers import mapped

ENCODER_VERSION = "word-bpe-1"
CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + ENCODER_VERSION.encode()).hexdigest()


def normalised(text: str):
    """The text without differences of white space, which the word tokenizers of this encoder drop between words."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \t-\r]+", " "))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """What the cache has for one tokenizer; each has a folder of its own."""
    folder = f"{cache}/version={version}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``).

    ``path`` names a word-level vocabulary as :class:`bpe.WordBpe` reads it. Null and empty
    texts have 0 bytes and tokens. Repeated texts are encoded once, repeated rows keep a row
    each, an empty table gives an empty one; other columns are left out, whatever their names.
    ``cache`` is a folder that all executors share; counts that two runs append twice are equal
    and count once. Texts of any length are encoded whole.

    Of each missing digest one row is chosen, the least by key and text hash. Only rows that a
    bit map of fixed size takes for chosen ones leave their place, so a run that finds all in
    the cache moves no text.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), said.alias("text"))
    place = F.xxhash64("key", "text")
    digest = F.unhex(F.sha2(normalised("text"), 256))
    digests = kept(rows.select("key", place.alias("place"), F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "digests")

    known = stored(spark, cache, version)
    chosen = digests.groupBy("digest").agg(F.min(F.struct("place", "n_bytes")).alias("row"))
    chosen = kept(chosen.join(known.select("digest"), "digest", "left_anti").select("row.place", "row.n_bytes", "digest"), "missing-digests")
    if not chosen.isEmpty():
        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = vocabulary(path, False)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.count(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

        placed = rows.select(place.alias("place"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
        moved = parted(placed, F.col("place"), chosen, F.col("place"))[1].dropDuplicates(["place", "n_bytes"])
        misses = moved.join(chosen, ["place", "n_bytes"]).select("digest", "text")
        mapped(misses, encode, CACHE_SCHEMA, "bpe").write.mode("append").parquet(f"{cache}/version={version}")

    counts = stored(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = digests.join(counts, "digest", "left")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
