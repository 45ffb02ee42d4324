"""Queries on text, path and hash functions and on row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.pages import image_words
from ..operators.sync import index_of
from .registry import query, table

_FILES = "SELECT doc_id, text, lang, source, 'doc_' || doc_id || '.txt' AS file_name, '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path FROM documents"


def files(spark, sf_dir):
    """Documents as files: a name and a path below source and language."""
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").withColumns({"file_name": name, "file_path": F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name)})


@query(f"SELECT doc_id, '[Fichier: ' || file_name || ' | Chemin: ' || source || '/' || lang || ' | Type: TXT]' AS context FROM ({_FILES})")
def file_context_header(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.file_context(F.col("file_name"), F.col("file_path"), F.lit("txt")).alias("context"))


@query(f"""SELECT doc_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', ((('0x'||substr(h,17,1))::INT & 3) + 1)::INT, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS point_id
FROM (SELECT doc_id, sha1(unhex('{T.POINT_NAMESPACE}') || encode(file_name || '_chunk_0')) AS h FROM ({_FILES}))""")
def point_ids(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.point_id(F.concat("file_name", F.lit("_chunk_0"))).alias("point_id"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT event_id, substr(md5(user_id || '|' || event_id || '|' || event_type), 1, 16) AS quick_hash FROM events")
def quick_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.quick_hash(F.col("user_id"), F.col("event_id"), F.col("event_type")).alias("quick_hash"))


_CLEAN = "substr(regexp_replace(replace(trim({}), ' ', '_'), '[^A-Za-z0-9_-]', '', 'g'), 1, 64)"


@query("SELECT page_id, CASE WHEN y = '' THEN 'documents' WHEN regexp_matches(y, '^[0-9-]') THEN 'idx_' || y ELSE y END AS index_name, CASE WHEN z = '' THEN NULL WHEN regexp_matches(z, '^[0-9-]') THEN 'idx_' || z ELSE z END AS route_name FROM (SELECT page_id, " + _CLEAN.format("url") + " AS y, " + _CLEAN.format("lower(url)") + " AS z FROM pages)")
def sanitize_index(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.index_name(F.col("url")).alias("index_name"), T.index_name(F.col("url"), None, True).alias("route_name"))


@query("SELECT page_id, substr(lower(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 63) AS table_name FROM pages")
def sql_table_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sql_name(F.col("url")).alias("table_name"))


@query(f"""WITH f AS ({_FILES}), r AS (SELECT * FROM (VALUES ('/src0/', 'hot'), ('/src1/', NULL), ('/src2/', NULL)) v(prefix, given))
SELECT doc_id, coalesce(given, CASE WHEN prefix IS NOT NULL THEN lang END, 'documents') AS index_name FROM f LEFT JOIN r ON starts_with(file_path, prefix)""")
def route_index(spark, sf_dir):
    """Explicit index of the watched path, else its first sub-folder, else the default."""
    watched = [("/src0", "hot"), ("/src1", None), ("/src2/", None)]
    return files(spark, sf_dir).select("doc_id", index_of(F.col("file_path"), watched).alias("index_name"))


@query("SELECT doc_id, strip_accents(replace(replace(text, '’', ''''), '‘', '''')) AS plain FROM documents")
def deaccent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.deaccent(F.col("text")).alias("plain"))


@query()
def number_extract(spark, sf_dir):
    """RE2 has no look-behind: checked by a unit test."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.numbers(F.col("text"))), ",").alias("numbers"))


@query()
def page_citations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.cited_pages(F.col("text")), ",").alias("pages"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, length(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'))::BIGINT AS text_chars FROM pages")
def html_title_text(spark, sf_dir):
    html = F.col("html")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.length(bare).cast("long").alias("text_chars"))


@query("SELECT doc_id, length(text)::BIGINT AS chars, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def text_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


@query("""SELECT page_id, array_to_string(p[greatest(len(p) - 4, 1):len(p) - 1], '/') AS folder, replace(replace(regexp_replace(p[len(p)], '^\\d{8}_?', ''), '_', ' '), '-', ' ') AS words
FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)""")
def image_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", image_words(F.col("url")).alias("w")).select("page_id", "w.folder", "w.words")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr'")
def facet_filter_scalar(spark, sf_dir):
    from ..operators.retrieval import facet_filter

    return facet_filter(table(spark, sf_dir, "documents"), {"lang": "fr", "source": None}).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('fr', 'es') AND source IN ('src0', 'src3')")
def facet_filter_list(spark, sf_dir):
    from ..operators.retrieval import facet_filter

    return facet_filter(table(spark, sf_dir, "documents"), {"lang": ["fr", "es"], "source": ["src0", "src3"]}).select("doc_id", "lang", "source")


#: Each entry of the lists of eligibility in a name of its own, and what becomes of it.
_NAMED = (
    [(f"a{x}", "temporary extension") for x in ".tmp .temp .swp .swo .swn .lock .lck .pid .bak .bak2 .orig .ds_store .thumbs .TMP .Bak2".split()]
    + [(f"b{x}", "") for x in ".pdf .docx .doc .odt .pptx .ppt .odp .xlsx .xls .ods .txt .md .csv .rtf .html .htm .xml .json .msg .eml .PDF".split()]
    + [("b.rst", "excluded extension"), ("c.log", "unsupported extension"), ("c.exe", "unsupported extension"), ("c.txt~", "unsupported extension"), ("c~", ""), ("c", ""), (".bashrc", ""), ("c.d/e", "")]
    + [("~$d.docx", "temporary name"), (".~d.odt", "temporary name"), ("._d.pdf", "temporary name"), ("~d.md", ""), ("~d", "")]
    + [(f"{x}/e.txt", "excluded folder") for x in ".git .svn .hg __pycache__ .pytest_cache node_modules .venv venv env Thumbs.db .DS_Store mine".split()]
    + [("thumbs.db", "unsupported extension"), ("Thumbs.db", "unsupported extension"), (".DS_Store", "excluded folder"), (".ds_store", ""), ("ENV/e.txt", ""), ("venv", "excluded folder")]
)


@query(f"""SELECT page_id, n.name, CASE WHEN n.reason <> '' THEN n.reason WHEN octet_length(encode(html)) > 1500 THEN 'too large' END AS reason
FROM pages, (SELECT unnest([{', '.join(f"{{'name': '{n}', 'reason': '{r}'}}" for n, r in _NAMED)}]) AS n)""")
def file_ignore_reason(spark, sf_dir):
    """Every entry of the lists of eligibility, and of the settings' own, under the address of every page; its size is the page's."""
    from ..operators.sync import ignore_reason

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").alias("size"))
    files = pages.select("page_id", "url", "size", F.explode(F.array(*[F.lit(n) for n, _ in _NAMED])).alias("name"))
    reason = ignore_reason(F.concat("url", F.lit("/"), "name"), size=F.col("size"), excluded_dirs=("mine",), excluded_extensions=(".rst",), most_mb=1500 / 1024 / 1024)
    return files.select("page_id", "name", reason.alias("reason"))


@query()
def toc_passages(spark, sf_dir):
    """Documents that read like a table of contents; checked by a unit test."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_contents_page(F.col("text")).alias("is_contents"))


@query("""WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS bare FROM pages)
SELECT page_id, length(CASE WHEN length(html) >= 200 AND length(bare) < 0.7 * length(html) THEN html ELSE bare END)::BIGINT AS chars, length(trim(bare)) < 50 OR len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: x <> '')) < 8 AS needs_ocr FROM p""")
def yield_guard(spark, sf_dir):
    """The text of a page without its marks against the raw page."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    df = table(spark, sf_dir, "pages").withColumn("bare", bare)
    ocr = T.needs_ocr(F.length(F.trim("bare")), F.size(F.array_remove(F.split("bare", r"\s+"), "")))
    return df.select("page_id", F.length(T.kept_yield(F.col("html"), F.col("bare"), 0.7)).cast("long").alias("chars"), ocr.alias("needs_ocr"))
