"""Queries on pages, front matter and sections: turns of ``conversations`` are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from .registry import query, table


def _turns(spark, sf_dir):
    """Every fourth page is blank."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), F.when(F.col("turn") % 4 == 3, " \n").otherwise(F.col("text")).alias("text"))


_SAID = "(SELECT conv_id, turn::INT AS page, CASE WHEN turn % 4 = 3 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS said FROM conversations)"
_JOINED = f"""p AS (SELECT conv_id, page, said, sum(CASE WHEN said <> '' THEN length(said) + 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY page) - CASE WHEN said <> '' THEN length(said) + 2 ELSE 0 END AS start FROM {_SAID}),
d AS (SELECT conv_id, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY page) FILTER (said <> ''), '') AS content, coalesce(string_agg(page || ':' || start || '-' || (start + length(said)), ',' ORDER BY page) FILTER (said <> ''), '') AS spans FROM p GROUP BY conv_id)"""


def _spans():
    return F.array_join(F.transform("page_spans", lambda x: F.concat(x["page"], F.lit(":"), x["start"], F.lit("-"), x["end"])), ",")


@query(f"WITH {_JOINED} SELECT conv_id, sha256(content) AS content, spans FROM d")
def joined_pages(spark, sf_dir):
    return P.joined(_turns(spark, sf_dir), "conv_id").select("conv_id", F.sha2("content", 256).alias("content"), _spans().alias("spans"))


@query(f"""WITH {_JOINED}, o AS (SELECT conv_id, page, chr(10) || '--- OCR Page ' || page || ' ---' || chr(10) || CASE page % 4 WHEN 0 THEN 'lu ' || page WHEN 1 THEN 'lu ' || page || chr(10) || 'ligne' WHEN 2 THEN 'ligne' END AS s FROM p WHERE said = '' AND page % 4 < 3),
q AS (SELECT o.conv_id, page, s, length(content) + 2 + sum(length(s) + 1) OVER (PARTITION BY o.conv_id ORDER BY page) - length(s) - 1 AS start FROM o JOIN d USING (conv_id)),
r AS (SELECT conv_id, string_agg(s, chr(10) ORDER BY page) AS more, string_agg(page || ':' || start || '-' || (start + length(s)), ',' ORDER BY page) AS spans FROM q GROUP BY conv_id)
SELECT conv_id, sha256(content || coalesce(chr(10) || chr(10) || more, '')) AS content, CASE WHEN r.spans IS NULL THEN d.spans WHEN d.spans = '' THEN r.spans ELSE d.spans || ',' || r.spans END AS spans FROM d LEFT JOIN r USING (conv_id)""")
def ocr_merge(spark, sf_dir):
    """Blank pages read by a stand-in, in blocks of which some are not sure enough."""
    turns = _turns(spark, sf_dir)
    blank, k = turns.where(~F.col("text").rlike(r"\S")), F.col("page") % 4
    block = lambda at, said, sure: F.struct(F.lit(at).alias("place"), said.alias("text"), sure.cast("double").alias("confidence"))
    blocks = F.array(block(1, F.lit("ligne"), F.when(k == 1, 0.3).when(k == 2, 0.9).otherwise(0.29)), block(0, F.concat(F.lit("lu "), "page"), F.when(k <= 1, 0.7)), block(2, F.lit(None).cast("string"), F.lit(0.9)))
    read = P.read_texts(blank.select("conv_id", "page", F.explode(blocks).alias("b")).select("conv_id", "page", "b.*"), "conv_id")
    return P.merged_ocr(P.joined(turns, "conv_id"), read, "conv_id").select("conv_id", F.sha2("content", 256).alias("content"), _spans().alias("spans"))


@query(f"""WITH s AS (SELECT conv_id, page, length(said) AS c, len(list_filter(regexp_split_to_array(said, '\\s+'), lambda x: x <> '')) AS w FROM {_SAID})
SELECT conv_id, page, c < 50 OR w < 8 OR sum(c) OVER (PARTITION BY conv_id) < 50 * count(*) OVER (PARTITION BY conv_id) // 2 AS ocr FROM s""")
def scanned_pages(spark, sf_dir):
    return P.scanned(_turns(spark, sf_dir), "conv_id").select("conv_id", F.col("page").cast("int").alias("page"), "ocr")


@query("SELECT conv_id, turn AS page, CASE WHEN bool_or(turn % 13 = 12) OVER (PARTITION BY conv_id, (turn - 1) // 10) THEN text ELSE '# ' || text END AS chosen FROM (SELECT conv_id, turn + 1 AS turn, text FROM conversations)")
def page_batches(spark, sf_dir):
    """Rich texts of pages, plain ones where a page of the batch of ten failed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    rich = turns.withColumn("markdown", F.when(F.col("page") % 13 != 12, F.concat(F.lit("# "), "text")))
    return P.with_fallback(rich, "conv_id").select("conv_id", "page", "chosen")


@query("SELECT conv_id, avg(length(text)) > 500 AS drawn FROM conversations GROUP BY conv_id")
def drawn_documents(spark, sf_dir):
    return P.drawn(table(spark, sf_dir, "conversations").withColumn("drawings", F.length("text")), "conv_id")


@query("""SELECT conv_id || '-' || turn AS k, role AS client, CASE WHEN turn % 2 = 0 THEN '2024-01-01' END AS date, text AS body FROM conversations""")
def front_matter(spark, sf_dir):
    day = F.when(F.col("turn") % 2 == 0, F.lit("date: 2024-01-01\n")).otherwise(F.lit("  - item\n"))
    raw = F.concat(F.lit("﻿---\nclient: \""), "role", F.lit("\"\n"), day, F.lit("---\n"), "text")
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), raw.alias("raw"))
    return P.front_matter(docs, "raw").select("k", "client", "date", "body")


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Remarque ' || turn ELSE text END AS said, sum(CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
SELECT conv_id, min(turn)::INT AS number, coalesce(max(said) FILTER (turn % 3 = 2), '') AS question, coalesce(max(said) FILTER (turn % 3 = 0), '') AS answer FROM b WHERE s > 0 GROUP BY conv_id, s""")
def remark_sections(spark, sf_dir):
    """Every third turn opens a remark, the next asks, the one after answers."""
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Remarque "), "turn")).otherwise(F.col("text"))
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return P.remarks(blocks, "conv_id", "turn", "said").drop("sources")
