"""Names that contain a string, from an index of their trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a gram, and parts of the table of grams.
SIZE, PARTS = 3, 64


def grams(text: Column) -> Column:
    """Distinct runs of ``SIZE`` characters of a text in small letters."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - SIZE + 1, F.lit(0)))
    there = F.when(F.length(low) >= SIZE, F.transform(starts, lambda i: F.substring(low, i, F.lit(SIZE))))
    return F.array_distinct(F.coalesce(there, F.array().cast("array<string>")))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


class NameIndex:
    """``names`` (``key, name``) and ``grams`` (``gram, key``, dealt by gram into ``PARTS`` folders)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.names, self.grams = (spark.read.parquet(f"{folder}/{x}") for x in ("names", "grams"))

    @classmethod
    def build(cls, rows: DataFrame, key: str, name: str, folder: str) -> NameIndex:
        """Index one name for each ``key``. Null names are found by nothing."""
        named = rows.select(F.col(key).alias("key"), F.col(name).alias("name")).where("name is not null and key is not null")
        named.write.parquet(f"{folder}/names")
        pairs = named.select("key", F.explode(grams(F.col("name"))).alias("gram")).withColumn("part", _part(F.col("gram")))
        pairs.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{folder}/grams")
        return cls(rows.sparkSession, folder)

    def containing(self, needle: str) -> DataFrame:
        """``key, name`` of names that hold ``needle``, case apart: those that have all its trigrams, looked at themselves. A shorter needle is looked for in every name."""
        own = [r[0] for r in self.spark.range(1).select(F.explode(grams(F.lit(needle)))).collect()]
        said = F.contains(F.lower("name"), F.lower(F.lit(needle)))
        if not own:
            return self.names.where(said)
        parts = [r[0] for r in self.spark.createDataFrame([(g,) for g in own], "gram string").select(_part(F.col("gram"))).distinct().collect()]
        found = self.grams.where(F.col("part").isin(parts) & F.col("gram").isin(own))
        if len(own) > 1:
            found = found.groupBy("key").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(own))
        return self.names.join(found.select("key").distinct(), "key", "left_semi").where(said)
