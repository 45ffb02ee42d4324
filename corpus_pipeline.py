"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, minhash, quality_rules, secret_scan
from lectern.llm.queries import TOKENIZER
from lectern.llm.storage import kept, parted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row is judged for itself: null and empty texts have no words and go, repeated rows and
    ids stay or go by their texts, texts of any length are read whole, an empty table stays
    empty. All stages but the last return the columns of documents; other columns are left out.
    """
    return quality_rules.judge(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more, the first by id and text.

    Of rows with the same id and text one stays, the least; different texts of one id are
    documents of their own, and so are rows without an id, which come last. Null, empty and
    wordless texts are near no other. An empty table stays empty.
    """
    rows = _identified(docs)
    return _without(_once(rows), minhash.near_duplicates(rows.select("_row", "text"), k=5, percent=80, key="_row").where("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a telling share of benchmark words.

    Verdicts go by id and text, so repeated ids with other texts stay and repeated rows go or
    stay together. Null and empty texts are clean; an empty benchmark or table changes nothing.
    """
    rows = _identified(docs)
    marks = decontaminate.mark(rows.select("_row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")
    return _without(rows, marks.where("contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text. Every row stays, null texts stay null and count 0."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens: their number and digests of the ids and of the decoded text. Null texts have none; each row, repeated or not, gives a row."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


def _identified(docs: DataFrame) -> DataFrame:
    """``_row`` is what verdicts go by: a row's id and text, never null; in the order of ids, rows without one last."""
    digest = F.coalesce(F.unhex(F.md5("text")), F.unhex(F.lit("")))
    return docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), digest.alias("digest")))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Only rows that may be among the gone ones leave their place."""
    gone = kept(gone.select("_row").distinct(), "dropped")
    stay, unsure = parted(rows, F.xxhash64("_row"), gone, F.xxhash64("_row"))
    return stay.select(*COLUMNS).unionByName(unsure.join(gone, "_row", "left_anti").select(*COLUMNS))


def _once(rows: DataFrame) -> DataFrame:
    """Of rows with the same id and text the least one. Only repeated rows are brought together."""
    again = kept(rows.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row"), "repeated")
    single, several = parted(rows, F.xxhash64("_row"), again, F.xxhash64("_row"))
    least = several.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("least"))
    return single.select("_row", *COLUMNS).unionByName(least.select("_row", "least.*"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("secrets", secrets), ("tokens", tokens)]

#: Shingle sets, components and the tokenizer's encoding are beyond SQL over whole texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
