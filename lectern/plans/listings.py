"""Lists of the newest, failed, sampled and capped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as S
from ..operators import sync as Y
from .registry import query, table

_STATUS = "CASE event_id % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'pending' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'dead' END"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    """The newest fifty since a moment."""
    log = _log(spark, sf_dir)
    middle = F.timestamp_micros(F.unix_micros(F.min("ts")) + ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 2).cast("long"))
    since = log.agg(middle.alias("since"))
    return Y.recent(log.crossJoin(F.broadcast(since)).where("ts >= since"), 50, "ts", "event_id").select("event_id", "event_type")


@query(f"SELECT event_id, status FROM (SELECT event_id, ts, {_STATUS} AS status FROM events) WHERE status IN ('failed', 'dead') ORDER BY ts DESC, event_id DESC LIMIT 20")
def failed_jobs(spark, sf_dir):
    jobs = _log(spark, sf_dir).withColumn("status", F.expr(_STATUS)).where("status IN ('failed', 'dead')")
    return Y.recent(jobs, 20, "ts", "event_id").select("event_id", "status")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def table_sample(spark, sf_dir):
    return S.sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 10, "p_partkey")


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 10000")
def scan_cap(spark, sf_dir):
    """A scan takes ten thousand files at most, in the order of their paths."""
    return table(spark, sf_dir, "pages").select("page_id", "url").orderBy("url", "page_id").limit(Y.MOST_SCANNED)


@query("SELECT user_id, max(ts)::TIMESTAMP AS updated_at, count(*)::BIGINT AS n FROM events GROUP BY user_id ORDER BY updated_at DESC, user_id LIMIT 100")
def tables_by_update(spark, sf_dir):
    made = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n"))
    return made.orderBy(F.desc("updated_at"), "user_id").limit(100)


@query("(SELECT 'scores' AS list, doc_id FROM labels ORDER BY doc_id DESC LIMIT 200) UNION ALL (SELECT 'history', doc_id FROM labels WHERE quality = 1 ORDER BY doc_id DESC LIMIT 50)")
def score_history(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    last = lambda df, n, name: df.orderBy(F.desc("doc_id")).limit(n).select(F.lit(name).alias("list"), "doc_id")
    return last(rows, 200, "scores").unionByName(last(rows.where("quality = 1"), 50, "history"))


@query("SELECT doc_id, chunk FROM (SELECT doc_id, unnest(range(0, 3)) AS chunk FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def cascade_delete(spark, sf_dir):
    """Chunks go with their documents."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("chunk"))
    left = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_anti")
    return Y.with_parent(chunks, left, "doc_id")


_ENDS = ("a.md", "a.TMP", "~$a.md", ".DS_Store", "~a.md", "Thumbs.db")
_WHY = "[NULL, 'temporary extension', 'temporary name', 'excluded folder', NULL, 'excluded folder']"


@query(f"SELECT event_type, reason IS NOT NULL AS ignored, coalesce(reason, '') AS reason, count(*)::BIGINT AS n FROM (SELECT event_type, {_WHY}[(event_id % 6 + 1)::INT] AS reason FROM events) GROUP BY ALL")
def event_log(spark, sf_dir):
    """Every raw event is logged with whether, and why, it is ignored."""
    name = F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("event_id") % 6 + 1).cast("int"))
    log = Y.logged(table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("/w/"), name)), F.col("path"), (".md", ".db"))
    return log.groupBy("event_type", "ignored", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, page_id % 5 IN (0, 2, 3) AND octet_length(encode(html)) <= 1500 AS takes, page_id % 5 IN (0, 3) AS takes_default, page_id % 5 = 0 AS takes_folders FROM pages")
def allowed_extensions(spark, sf_dir):
    """A list of the configuration, with or without points, in place of the default one; files up to a size; a scan that looks at folders."""
    path = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in ("f.pdf", "f.xyz", "f.foo", "/env/f.PDF", "/~$f.pdf")]), (F.col("page_id") % 5 + 1).cast("int")))
    takes = Y.taken(path, ("pdf", ".foo"), F.octet_length("html"), most_mb=1500 / 1024 / 1024)
    return table(spark, sf_dir, "pages").select("page_id", takes.alias("takes"), Y.taken(path).alias("takes_default"), Y.taken(path, folders=True).alias("takes_folders"))


@query("SELECT e.event_id, d.doc_id FROM events e LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = e.user_id")
def jobs_to_documents(spark, sf_dir):
    """Jobs with the document at their path; tombstones are no documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, "deleted").otherwise("indexed").alias("status"))
    jobs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"))
    return Y.at_path(jobs, docs).select("event_id", "doc_id")
