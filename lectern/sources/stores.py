"""Sinks: tables with a catalog, index tables, exports and imports.

The catalog of sheets is an append-only table; its newest row for each name tells whether the
table is there. So a registration is one small append, and no table is rewritten while read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.analytics import report
from ..operators.sync import latest

CATALOG = "sheet_catalog"


def _register(spark: SparkSession, names: DataFrame, dropped: bool) -> None:
    rows = names.select("table_name", "source_file", "sheet_name", "columns", "row_count", F.current_timestamp().alias("at"), F.lit(dropped).alias("dropped"))
    rows.write.mode("append").saveAsTable(CATALOG)


def sheet_catalog(spark: SparkSession) -> DataFrame:
    """The newest row of each table that has not been dropped since."""
    return latest(spark.table(CATALOG), ["table_name"], F.col("at"), ~F.col("dropped")).where("not dropped").drop("dropped")


def replace_table(df: DataFrame, name: str, source_file: str, sheet_name: str) -> None:
    """Write a sheet as a table in place of one of that name, and register it."""
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(name)
    row = (name, source_file, sheet_name, ",".join(df.columns), spark.table(name).count())
    _register(spark, spark.createDataFrame([row], "table_name string, source_file string, sheet_name string, columns string, row_count long"), False)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
    _register(spark, sheet_catalog(spark).where(F.col("table_name") == name), True)


def drop_source(spark: SparkSession, source_file: str) -> list[str]:
    """Drop all tables of one file; returns their names (a file's sheets are few)."""
    names = [r["table_name"] for r in sheet_catalog(spark).where(F.col("source_file") == source_file).select("table_name").collect()]
    for name in names:
        drop_table(spark, name)
    return names


def create_index(df: DataFrame, name: str, key: str = "document_id", buckets: int = 64) -> bool:
    """An index table bucketed by ``key``, so that changes join it without a shuffle. False if it is there already."""
    if df.sparkSession.catalog.tableExists(name):
        return False
    df.write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return True


def drop_index(spark: SparkSession, name: str) -> None:
    """Drop the index of that name, and of its lower-case spelling."""
    for x in dict.fromkeys((name, name.lower())):
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": x})


def clear_indexes(spark: SparkSession, prefix: str) -> list[str]:
    """Drop every index table whose name begins with ``prefix``, whatever its case; returns their names (indexes are few)."""
    names = [t.name for t in spark.catalog.listTables() if not t.isTemporary and t.name.lower().startswith(prefix.lower())]
    for name in names:
        drop_index(spark, name)
    return names


def scroll(spark: SparkSession, name: str, after: object = None, key: str = "document_id", size: int = 1000) -> DataFrame:
    """One page of an index in the order of its keys: the ``size`` rows behind ``after``. A reader that gives the last key it saw sees every row once."""
    rows = spark.table(name)
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


BOM = "\ufeff"


def export_csv(df: DataFrame, path: str, *order: str, bom: bool = False) -> None:
    """All cells quoted, ``;`` between them, nulls as empty cells; newest first by ``order``. ``bom`` puts a byte order mark before each file's header, for readers that need one to see UTF-8."""
    texts = df.orderBy(*[F.desc(c) for c in order]) if order else df
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    if not bom:
        texts.select(*cells).write.option("emptyValue", "").csv(path, sep=";", quoteAll=True, header=True, escape='"', encoding="UTF-8", mode="overwrite")
        return
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    head = BOM + ";".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = texts.select(F.concat_ws(";", *[quoted(c) for c in cells]).alias("line"))
    # The header stands before the first line of each file.
    first = lines.withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).select(F.when(F.col("_n") == 0, F.concat(F.lit(head + "\n"), "line")).otherwise(F.col("line")).alias("line"))
    first.write.mode("overwrite").text(path)


def export_points(df: DataFrame, path: str) -> None:
    """One JSON object on a line for each point."""
    df.write.mode("overwrite").json(path)


def export_wrapped(df: DataFrame, path: str, name: str, kind: str = "points") -> None:
    """Files of one object each, ``{collection, points}`` or ``{index, documents}``: a file for each partition, so no file holds more than a task does."""
    label = "collection" if kind == "points" else "index"
    body = F.to_json(F.struct(*df.columns))
    part = F.spark_partition_id()
    rows = df.select(part.alias("_part"), body.alias("_body")).groupBy("_part").agg(F.array_join(F.collect_list("_body"), ",").alias("_all"))  # one partition's rows
    rows.select(F.concat(F.lit(f'{{"{label}": "{name}", "{kind}": ['), "_all", F.lit("]}"))).write.mode("overwrite").text(path)


def import_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Points of an export, of either form, with ``number`` where the id is a whole number and ``uuid`` where it is one."""
    wrapped = f"points array<struct<{_fields(schema)}>>, documents array<struct<{_fields(schema)}>>"
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    both = lines.select(F.from_json("value", wrapped).alias("w"), F.from_json("value", schema).alias("p"))
    inner = F.coalesce("w.points", "w.documents", F.array("p"))
    points = both.select(F.explode(inner).alias("p")).select("p.*")
    uuid = F.when(F.col("id").rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower("id"))
    return points.withColumns({"number": F.col("id").try_cast("bigint"), "uuid": uuid})


def _fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def export_campaign(rows: DataFrame, made: DataFrame, folder: str) -> None:
    """A campaign's rows as JSON lines and its report as text, below ``folder``."""
    rows.write.mode("overwrite").json(f"{folder}/rows")
    report(made).orderBy("nth").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/report")  # a line for each project
