"""Pages to documents: joined texts with the places of pages, fallbacks, scanned pages, front matter, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Pages of a batch, characters and words under which a page is scanned, drawings of a page above which a document is drawn.
PAGE_BATCH, LEAST_CHARS, LEAST_WORDS, MOST_DRAWINGS = 10, 50, 8, 500
#: Where a front matter stands and which of its keys become columns; what heads a section of remarks.
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n?"
PROMOTED = ("client", "editor", "technology", "product", "version", "support_type", "severity", "ticket_id", "date", "projet", "phase", "thematique", "departement")
REMARK = r"(?i)^\s*remarque\s*(?:n°\s*)?(\d+)"
SPAN = "array<struct<start:int,end:int,page:int>>"


def joined(pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """``key, content, page_spans`` of each document: its pages with text, in order, a blank line between them, and where each begins and ends. A document without text has an empty content and no spans."""
    said = T.strip(F.coalesce(text, F.lit("")))
    w = Window.partitionBy(key).orderBy(page)
    rows = pages.select(key, F.col(page).cast("int").alias("_page"), said.alias("_said"))
    there = F.col("_said") != ""
    size = F.when(there, F.length("_said") + 2).otherwise(0)
    placed = rows.withColumn("_start", (F.sum(size).over(Window.partitionBy(key).orderBy("_page")) - size).cast("int"))
    one = F.when(there, F.struct(F.col("_page").alias("page"), F.col("_start").alias("start"), F.col("_said").alias("said")))
    made = placed.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("p"))  # one document's pages
    spans = F.transform("p", lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["said"])).alias("end"), x["page"].alias("page")))
    return made.select(key, F.array_join(F.transform("p", lambda x: x["said"]), "\n\n").alias("content"), spans.cast(SPAN).alias("page_spans"))


def with_fallback(pages: DataFrame, key: str, page: str = "page", rich: str = "markdown", plain: str = "text") -> DataFrame:
    """``pages`` with ``chosen``: the rich text of each page, but the plain one of all pages of a batch (ten in a row) in which a page has no rich text."""
    batch = F.floor((F.col(page) - 1) / PAGE_BATCH)
    failed = F.max(F.col(rich).isNull()).over(Window.partitionBy(key, batch))
    return pages.withColumn("chosen", F.when(failed, F.col(plain)).otherwise(F.col(rich)))


def scanned(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``pages`` with ``ocr``: has the page too few characters or words, or its document too few for its pages?"""
    said = T.strip(F.coalesce(text, F.lit("")))
    chars, words = F.length(said), F.size(F.array_remove(F.split(said, r"\s+"), ""))
    w = Window.partitionBy(key)
    return pages.withColumn("ocr", T.needs_ocr(chars, words) | (F.sum(chars).over(w) < F.floor(LEAST_CHARS * F.count(F.lit(1)).over(w) / 2)))


#: Fixed value: the least confidence of a block that counts.
LEAST_CONFIDENCE = 0.3


def read_texts(blocks: DataFrame, key: str, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``key, page, text`` from the blocks that a reader has found on scanned pages (``key, page, place, text, confidence``): those of enough confidence, a line each in their order. Blocks without a confidence don't count; pages without a block have none."""
    sure = blocks.where((F.col("confidence") >= least) & F.col("text").isNotNull())
    lists = sure.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("b"))  # one page's blocks
    return lists.select(key, "page", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))


def merged_ocr(documents: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """``documents`` (``content, page_spans``) with the texts ``read`` from scanned pages (``key, page, text``) behind them, each under a line that names its page, and their spans."""
    section = F.concat(F.lit("\n--- OCR Page "), "page", F.lit(" ---\n"), "text")
    rows = read.where(F.coalesce("text", F.lit("")).rlike(r"\S")).select(key, F.struct(F.col("page").cast("int").alias("page"), section.alias("said")).alias("s"))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))  # one document's pages
    start = F.struct((F.length("content") + 2).alias("at"), F.array().cast(SPAN).alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["said"]) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["said"])).alias("end"), x["page"].alias("page")))).alias("out"))
    both = documents.join(found, key, "left")
    spans = F.concat("page_spans", F.aggregate("s", start, step)["out"])
    content = F.concat("content", F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["said"]), "\n"))
    return both.select(key, F.coalesce(content, F.col("content")).alias("content"), F.coalesce(spans, F.col("page_spans")).alias("page_spans"))


def drawn(pages: DataFrame, key: str, drawings: str = "drawings", most: int = MOST_DRAWINGS) -> DataFrame:
    """``key, drawn``: has a document so many drawings a page that its layout is not worth reading?"""
    return pages.groupBy(key).agg((F.avg(drawings) > most).alias("drawn"))


def front_matter(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``front`` (a map of the flat keys of its front matter), the promoted keys as columns and ``body``, the text without it. A byte order mark is no text."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", "")
    lines = F.filter(F.split(F.regexp_extract(raw, FRONT_MATTER, 1), "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    value = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+\s*:", "")), "^[\"']", ""), "[\"']$", "")
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("k"), value(x).alias("v"))))
    return docs.withColumns({"front": pairs, "body": F.regexp_replace(raw, FRONT_MATTER, "")}).withColumns({k: F.try_element_at("front", F.lit(k)) for k in PROMOTED})


def remarks(blocks: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """``key, number, question, answer, sources`` of a reviewed document's remarks: a block that names a remark opens it, the next block asks, the others answer until the next remark. What stands before the first belongs to none."""
    w = Window.partitionBy(key).orderBy(place)  # one document
    number = F.regexp_extract(F.coalesce(text, F.lit("")), REMARK, 1)
    rows = blocks.withColumn("_opens", (number != "").cast("int")).withColumn("_section", F.sum("_opens").over(w)).where("_section > 0")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_section").orderBy(place)))
    made = rows.groupBy(key, "_section").agg(
        F.max(F.when(F.col("_nth") == 1, number)).cast("int").alias("number"), F.max(F.when(F.col("_nth") == 2, F.col(text))).alias("question"),
        F.array_sort(F.collect_list(F.when(F.col("_nth") > 2, F.struct("_nth", F.col(text).alias("said"))))).alias("a"),
    )
    answer = F.array_join(F.transform("a", lambda x: x["said"]), "\n")
    return made.select(key, "number", F.coalesce("question", F.lit("")).alias("question"), answer.alias("answer"), T.source_mentions(answer).alias("sources"))


def image_words(path: Column) -> Column:
    """What an image's name and folder say: ``folder`` (the last four parts above it), ``words`` (the name without a date before it)."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    folder = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 4, F.lit(1)), F.least(F.lit(4), F.size(parts) - 1)), "/")
    return F.struct(folder.alias("folder"), F.translate(F.regexp_replace(F.element_at(parts, -1), r"^\d{8}_?", ""), "_-", "  ").alias("words"))
