"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tables
from ..operators import chunking as C
from .registry import query, table
from .text import files

_FIXED = """SELECT doc_id, i::INT AS chunk_index, (i * {step})::INT AS start, least(i * {step} + {size}, length(text))::INT AS "end", regexp_replace(substr(text, (i * {step} + 1)::BIGINT, {size}), '^\\s+|\\s+$', '', 'g') AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE (length(text) - {size} + {step} - 1) // {step} + 1 END)) AS i FROM documents)"""


@query(_FIXED.format(size=1024, step=874))
def chunk_fixed(spark, sf_dir):
    return C.fixed(table(spark, sf_dir, "documents"), 1024, 150)


@query()
def chunk_sentence(spark, sf_dir):
    return C.packed(table(spark, sf_dir, "documents"), "sentence", 1024, 150)


@query()
def chunk_lateral(spark, sf_dir):
    """The sentence chunker as a table function of SQL; the rows of ``chunk_sentence``, by a unit test."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, c.* FROM {docs}, LATERAL chunk_sentence(text, 1024, 150) AS c", docs=table(spark, sf_dir, "documents"))


def _talks(spark, sf_dir, before=None, between="\n\n"):
    """Conversations as documents: turns in order, joined."""
    said = F.concat(before, F.col("text")) if before is not None else F.col("text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))  # one conversation's turns
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["said"]), between).alias("text"))


@query()
def chunk_email(spark, sf_dir):
    """Conversations as mails: the first turn's head, then what was said."""
    mails = _talks(spark, sf_dir).select("conv_id", F.concat(F.lit("Subject: talk "), "conv_id", F.lit("\nFrom: a@example.org\n\n"), "text").alias("text"))
    return C.packed(mails, "email", 800, 0, "conv_id")


@query()
def chunk_pages(spark, sf_dir):
    """First and last page of each chunk of conversations, turns as pages."""
    spans = _spans(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "page"))).alias("spans"))  # one document's pages
    chunks = C.packed(_talks(spark, sf_dir), "sentence", 600, 80, "conv_id").join(spans, "conv_id")
    return chunks.select("conv_id", "chunk_index", "start", "end", C.page_of(F.col("spans"), F.col("start")).alias("page_start"), C.page_of(F.col("spans"), F.col("end") - 1).alias("page_end"))


@query()
def chunk_paragraph(spark, sf_dir):
    return C.packed(_talks(spark, sf_dir), "paragraph", 800, 0, "conv_id")


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::INT AS chunk_index, '--- Slide ' || turn || ' ---' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS chunk FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def chunk_slide(spark, sf_dir):
    return C.slides(_talks(spark, sf_dir, F.concat(F.lit("--- Slide "), F.col("turn"), F.lit(" ---\n"))), "conv_id", "text")


@query("""SELECT w AS "window", count(*)::BIGINT AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, unnest(range(greatest(0, CAST(floor((place - 50) / 45.0) AS BIGINT) + 1), place // 45 + 1)) AS w FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)) GROUP BY w""")
def chunk_row_windows(spark, sf_dir):
    rows = C.row_windows(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return rows.groupBy("window").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""SELECT o_custkey, w AS "window", count(*)::BIGINT AS n_rows, min(o_orderkey) AS first_key
FROM (SELECT o_custkey, o_orderkey, unnest(range(greatest(0, CAST(floor((place - 50) / 45.0) AS BIGINT) + 1), place // 45 + 1)) AS w FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)) GROUP BY ALL""")
def chunk_row_windows_by_key(spark, sf_dir):
    rows = C.row_windows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], by="o_custkey")
    return rows.groupBy("o_custkey", "window").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT doc_id, coalesce(s.strategy, 'sentence') AS strategy, coalesce(s.size, 1024)::INT AS size, coalesce(s.overlap, 150)::INT AS overlap
FROM (SELECT doc_id, CASE kind WHEN 'excel' THEN 'xlsx' WHEN 'text' THEN 'txt' WHEN 'email' THEN 'msg' ELSE kind END AS kind FROM (SELECT doc_id, ['pdf', 'excel', 'text', 'email', 'html'][(doc_id % 5 + 1)::INT] AS kind FROM documents)) d
LEFT JOIN (VALUES ('pdf', 'sentence', 1500, 200), ('xlsx', 'fixed', 2000, 0), ('msg', 'email', 800, 0), ('txt', 'paragraph', 1000, 100)) s(kind, strategy, size, overlap) USING (kind)""")
def chunk_strategy_resolution(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "excel", "text", "email", "html")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return C.strategies(table(spark, sf_dir, "documents").select("doc_id", kinds.alias("kind")), "kind").drop("kind")


@query("""SELECT doc_id, CASE WHEN length(text) <= 150 THEN '' WHEN regexp_matches(substr(text, length(text) - 150, 1), '\\s') THEN right(text, 150)
WHEN regexp_matches(right(text, 150), '\\s') THEN regexp_replace(right(text, 150), '(?s)^\\S*\\s', '') ELSE '' END AS tail FROM documents""")
def overlap_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.overlap_tail(F.col("text"), 150).alias("tail"))


_MD = """md AS (SELECT n_regionkey, 'Nations' || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || 'End.' AS text FROM nation GROUP BY n_regionkey)"""


def _tables(spark, sf_dir):
    row = F.concat(F.lit("| "), "n_nationkey", F.lit(" | "), "n_name", F.lit(" |"))
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    return grouped.select("n_regionkey", F.concat(F.lit("Nations\n| key | name |\n|---|---|\n"), F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("\nEnd.")).alias("text"))


@query(f"WITH {_MD} SELECT n_regionkey, 1::BIGINT AS block, 1 AS first_line, (len(string_split(text, chr(10))) - 2)::BIGINT AS n_lines FROM md")
def md_table_blocks(spark, sf_dir):
    return C.tables_of(_tables(spark, sf_dir), "n_regionkey", "text").select("n_regionkey", "block", "first_line", "n_lines")


@query(f"""WITH {_MD}, c AS (SELECT n_regionkey, text, unnest(range(0, CASE WHEN length(text) <= 60 THEN 1 ELSE (length(text) - 1) // 60 + 1 END)) AS i FROM md),
t AS (SELECT *, length('Nations') + 1 AS ts, length('Nations') + 1 + length('| key | name |') + 1 + length('|---|---|') AS he, length(text) - length('End.') AS te FROM c)
SELECT n_regionkey, i::INT AS chunk_index, CASE WHEN i * 60 > he AND i * 60 < te THEN '| key | name |' || chr(10) || '|---|---|' || chr(10) ELSE '' END || regexp_replace(substr(text, (i * 60 + 1)::BIGINT, 60), '^\\s+|\\s+$', '', 'g') AS with_header FROM t""")
def md_header_reinjection(spark, sf_dir):
    docs = _tables(spark, sf_dir)
    return C.with_headers(C.fixed(docs, 60, 0, "n_regionkey"), C.tables_of(docs, "n_regionkey", "text"), "n_regionkey").select("n_regionkey", "chunk_index", "with_header")


_SPANS = "SELECT conv_id, turn AS page, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 2)::BIGINT AS start, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2)::BIGINT AS \"end\" FROM conversations"


def _spans(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text") + 2
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), (F.sum(size).over(w) - size).alias("start"), (F.sum(size).over(w) - 2).alias("end"))


@query(_SPANS)
def page_spans(spark, sf_dir):
    """Turns as pages of a text joined by blank lines: running offsets."""
    return _spans(spark, sf_dir)


@query(f"""WITH s AS ({_SPANS}), p AS (SELECT conv_id, unnest(range(0, max("end"), 500)) AS pos FROM s GROUP BY conv_id)
SELECT p.conv_id, p.pos, max(s.page) AS page FROM p JOIN s ON p.conv_id = s.conv_id AND s.start <= p.pos GROUP BY ALL""")
def page_lookup_asof(spark, sf_dir):
    spans = _spans(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "page"))).alias("spans"), F.max("end").alias("size"))  # one document's pages
    at = spans.withColumn("pos", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest("size", F.lit(0)), F.lit(500).cast("long")), lambda x: x < F.col("size"))))
    return at.select("conv_id", "pos", C.page_of(F.col("spans"), F.col("pos")).alias("page"))


@query(f"""WITH c AS ({_FIXED.format(size=1024, step=874)}), f AS (SELECT doc_id, lang, source FROM documents)
SELECT doc_id, chunk_index, 'doc_' || doc_id || '.txt_chunk_' || chunk_index AS chunk_id, length('[Fichier: doc_' || doc_id || '.txt | Chemin: ' || source || '/' || lang || ' | Type: TXT]' || chr(10) || chunk)::BIGINT AS context_chars FROM c JOIN f USING (doc_id)""")
def chunk_records(spark, sf_dir):
    """Chunks as index records: id and text with its file context."""
    docs = files(spark, sf_dir)
    chunks = C.fixed(docs.withColumn("doc", F.struct("doc_id", "file_name", "file_path")), 1024, 150, "doc")
    context = T.file_context(F.col("doc.file_name"), F.col("doc.file_path"), F.lit("txt"))
    return chunks.select("doc.doc_id", "chunk_index", F.concat("doc.file_name", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), F.length(F.concat(context, F.lit("\n"), "chunk")).cast("long").alias("context_chars"))
