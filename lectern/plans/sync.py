"""Synchronisation queries: ``events`` is a log of file changes, ``user_id`` the file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sync as S
from ..operators.shared import once
from ..sources.names import NameIndex
from .registry import query, table

#: Fixed moment between what the store knows and what is new, so that results don't depend on the clock.
_CUT = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _halves(spark, sf_dir):
    log = _log(spark, sf_dir)
    cut = log.agg(F.timestamp_micros(F.unix_micros(F.min("ts")) + ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 2).cast("long")).alias("cut"))
    log = log.crossJoin(F.broadcast(cut))  # one row
    return log.where("ts < cut").drop("cut"), log.where("ts >= cut").drop("cut")


@query("""WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts))::BIGINT AS started_us, max_by(event_type, ts) AS last_action, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return S.debounced(_log(spark, sf_dir), "user_id", "ts", "event_type", "1 hour").select("user_id", F.unix_micros("started").alias("started_us"), "last_action", "n_events")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def enqueue_replace(spark, sf_dir):
    """A pending job of the same file and action is replaced by the newer one."""
    return S.latest(_log(spark, sf_dir), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


_PRIORITY = "CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"


@query(f"SELECT event_id, {_PRIORITY} AS priority FROM events ORDER BY priority DESC, ts, event_id LIMIT 20")
def next_jobs(spark, sf_dir):
    return _log(spark, sf_dir).withColumn("priority", F.expr(_PRIORITY)).orderBy(F.desc("priority"), "ts", "event_id").limit(20).select("event_id", "priority")


@query("SELECT event_id, least(60 * pow(2, (event_id % 8)), 3600)::BIGINT AS delay, CASE WHEN event_id % 8 + 1 >= 3 THEN 'dead' ELSE 'failed' END AS status FROM events")
def retry_backoff(spark, sf_dir):
    attempts = (F.col("event_id") % 8 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", S.backoff_seconds(attempts).alias("delay"), S.after_failure(attempts).alias("status"))


_STATUS = "CASE event_id % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'pending' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'dead' END"


@query(f"SELECT CASE status WHEN 'in_progress' THEN 'pending' ELSE status END AS status, count(*)::BIGINT AS n FROM (SELECT {_STATUS} AS status FROM events) GROUP BY ALL")
def crash_recovery(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.expr(_STATUS).alias("status"))
    return jobs.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_SNAP = "SELECT user_id AS path, max_by(event_type || event_id, (ts, event_id)) AS digest FROM events WHERE ts {} " + _CUT + " GROUP BY user_id"


def _snapshots(spark, sf_dir):
    return [S.latest(half, ["user_id"], F.col("ts"), F.col("event_id")).select(F.col("user_id").alias("path"), F.concat("event_type", "event_id").alias("digest")) for half in _halves(spark, sf_dir)]


@query(f"""WITH a AS ({_SNAP.format('>=')}), b AS ({_SNAP.format('<')})
SELECT path, CASE WHEN b.digest IS NULL THEN 'new' WHEN a.digest IS NULL THEN 'deleted' WHEN a.digest <> b.digest THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (path)""")
def reconcile_diff(spark, sf_dir):
    store, disk = _snapshots(spark, sf_dir)
    return S.reconciled(disk, store)


@query(f"WITH a AS ({_SNAP.format('>=')}), b AS ({_SNAP.format('<')}) SELECT change, count(*)::BIGINT AS n FROM (SELECT CASE WHEN b.digest IS NULL THEN 'new' WHEN a.digest IS NULL THEN 'deleted' WHEN a.digest <> b.digest THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (path)) GROUP BY change")
def reconcile_report(spark, sf_dir):
    return reconcile_diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH a AS ({_SNAP.format('>=')}), b AS ({_SNAP.format('<')}) SELECT path, coalesce(a.digest, b.digest) AS digest, (CASE WHEN b.digest IS NULL THEN 1 WHEN a.digest IS NULL OR a.digest = b.digest THEN 1 ELSE 2 END)::INT AS version FROM a FULL JOIN b USING (path)")
def cdc_upsert(spark, sf_dir):
    """Changed contents replace the stored row and raise its version; equal contents are skipped."""
    store, disk = (x.withColumn("version", F.lit(1)) for x in _snapshots(spark, sf_dir))
    known = store.select("path", F.col("digest").alias("old"), F.col("version").alias("was"))
    changes = disk.join(known, "path", "left").where("old IS NULL OR old <> digest").select("path", "digest", (F.coalesce("was", F.lit(0)) + 1).alias("version"))
    return S.replaced(store, changes, "path")


_LAST = "SELECT user_id, max_by(event_type, (ts, event_id)) AS last, max(ts) AS ts FROM events GROUP BY user_id"


@query(f"SELECT user_id, CASE WHEN last = 'logout' THEN 'deleted' ELSE 'indexed' END AS status FROM ({_LAST})")
def tombstones(spark, sf_dir):
    last = S.latest(_log(spark, sf_dir), ["user_id"], F.col("ts"), F.col("event_id"))
    return last.select("user_id", F.when(F.col("event_type") == "logout", "deleted").otherwise("indexed").alias("status"))


@query(f"""WITH l AS ({_LAST}), n AS (SELECT max(ts) AS now FROM events), k AS (SELECT user_id FROM l, n WHERE NOT (last = 'view' AND ts < now - INTERVAL 2 DAY))
SELECT user_id, (SELECT count(*) FROM events e WHERE e.user_id = k.user_id)::BIGINT AS chunks FROM k""")
def purge_tombstones(spark, sf_dir):
    """Deleted rows older than the retention go, and their chunks with them; ``now`` is the newest event."""
    log = _log(spark, sf_dir)
    last = S.latest(log, ["user_id"], F.col("ts"), F.col("event_id"))
    now = log.agg(F.max("ts").alias("now"))
    store = last.crossJoin(F.broadcast(now)).withColumns({"status": F.when(F.col("event_type") == "view", "deleted").otherwise("indexed"), "deleted_at": F.col("ts")})
    left, chunks = S.purged(store, log.select("user_id", "event_id"), "user_id", F.col("now"), 2)
    counts = chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"))
    return left.select("user_id").join(counts, "user_id")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, 'http', 'moved/http') ELSE url END AS path FROM pages")
def move_paths(spark, sf_dir):
    """A move changes path and name; nothing is indexed anew."""
    pages = table(spark, sf_dir, "pages")
    moves = pages.where("page_id % 3 = 0").select("page_id", F.replace("url", F.lit("http"), F.lit("moved/http")).alias("new"))
    return pages.join(moves, "page_id", "left").select("page_id", F.coalesce("new", "url").alias("path"))


@query("SELECT user_id, count(*)::BIGINT AS n_stable FROM (SELECT user_id, round(value) AS size, lag(round(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE size > 0 AND size = was GROUP BY user_id")
def stability(spark, sf_dir):
    """Files seen with the same positive size at two checks in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sizes = _log(spark, sf_dir).withColumn("size", F.round("value")).withColumn("was", F.lag("size").over(w))
    return sizes.where("size > 0 AND size = was").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_stable"))


@query("SELECT doc_id, source FROM documents WHERE lang NOT IN ('de', 'es')")
def delete_by_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("lang IN ('de', 'es')").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest_wins(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id")).select("user_id", "event_type", "value")


@query("SELECT event_type AS status, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def docs_by_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*)::BIGINT AS jobs, count(*) FILTER (status IN ('pending', 'failed'))::BIGINT AS waiting, count(*) FILTER (status = 'dead')::BIGINT AS dead, round(avg(value), 6) AS mean_ms FROM (SELECT {_STATUS} AS status, value FROM events)")
def service_metrics(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS))
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status").isin("pending", "failed")).alias("waiting"), F.count_if(F.col("status") == "dead").alias("dead"), F.round(F.avg("value"), 6).alias("mean_ms"))


@query("SELECT doc_id, source FROM documents WHERE source ILIKE '%SRC1%' ORDER BY doc_id LIMIT 20 OFFSET 40")
def paginate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").ilike("%SRC1%")).orderBy("doc_id").offset(40).limit(20).select("doc_id", "source")


@query("SELECT 'brand#1' AS needle, p_partkey, p_brand || ' ' || p_name AS name FROM part WHERE contains(lower(p_brand || ' ' || p_name), 'brand#1') UNION ALL SELECT '3 p', p_partkey, p_brand || ' ' || p_name FROM part WHERE contains(lower(p_brand || ' ' || p_name), '3 p') UNION ALL SELECT '#2', p_partkey, p_brand || ' ' || p_name FROM part WHERE contains(lower(p_brand || ' ' || p_name), '#2')")
def names_containing(spark, sf_dir):
    """Names that hold a string, from their trigrams; the last one is too short for any."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select("p_partkey", F.concat("p_brand", F.lit(" "), "p_name").alias("name"))
    index = NameIndex(spark, once(parts, "part-names", lambda folder: NameIndex.build(rows, "p_partkey", "name", folder)))
    found = [index.containing(needle).select(F.lit(needle.lower()).alias("needle"), F.col("key").alias("p_partkey"), "name") for needle in ("BRAND#1", "3 p", "#2")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT coalesce(a.k, b.k) AS name, a.n AS vectors, b.n AS documents FROM (SELECT 'src' || label AS k, count(*)::BIGINT AS n FROM embeddings GROUP BY k) a FULL JOIN (SELECT lower(source) AS k, count(*)::BIGINT AS n FROM documents GROUP BY k) b USING (k)")
def index_stats(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("src"), "label").alias("name")).agg(F.count(F.lit(1)).alias("vectors"))
    b = table(spark, sf_dir, "documents").groupBy(F.lower("source").alias("name")).agg(F.count(F.lit(1)).alias("documents"))
    return a.join(b, "name", "full_outer")
