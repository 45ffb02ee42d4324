"""Feedback and evaluation statistics: ``labels.quality`` is the thumb, ``events.value`` the time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import retrieval as R
from .registry import query, table


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CASE quality WHEN 1 THEN 'up' ELSE 'down' END AS feedback, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def feedback_stats_type(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(F.when(F.col("quality") == 1, "up").otherwise("down").alias("feedback")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def feedback_top_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL")
def feedback_daily(spark, sf_dir):
    """The last seven days before the newest event."""
    log = _log(spark, sf_dir)
    newest = log.agg(F.max("ts").alias("now"))
    recent = log.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAY"))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_SCORES = "SELECT d.source, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE (l.doc_id % 10) / 10.0::DOUBLE END AS faithfulness, (l.doc_id % 7) / 7.0::DOUBLE AS relevancy, l.quality::DOUBLE AS recall FROM labels l JOIN documents d USING (doc_id)"


def _scores(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("source", F.when(k % 9 != 0, (k % 10) / F.lit(10.0)).alias("faithfulness"), ((k % 7) / F.lit(7.0)).alias("relevancy"), F.col("quality").cast("double").alias("recall"))


@query(f"SELECT source, round(avg(faithfulness), 3) AS faithfulness, round(avg(relevancy), 3) AS relevancy, round(avg(recall), 3) AS recall, count(*)::BIGINT AS n FROM ({_SCORES}) GROUP BY source")
def eval_dashboard(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("source").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("faithfulness", "relevancy", "recall")], F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 3) AS mean, round(100.0 * count(*) FILTER ({m} < {t}) / count(*), 0)::DOUBLE AS failing, CASE WHEN avg({m}) < {g} THEN 'high' WHEN avg({m}) < {t} THEN 'medium' ELSE 'none' END AS severity FROM ({_SCORES})" for m, t, g in (("faithfulness", 0.8, 0.6), ("relevancy", 0.75, 0.5), ("recall", 0.7, 0.4))))
def eval_recommendations(spark, sf_dir):
    """Metrics against their thresholds; nulls don't count in means."""
    wide = _scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[x for m, (t, _) in A.GOALS.items() for x in (A.mean(m).alias(f"{m}_mean"), F.count_if(F.col(m) < t).alias(f"{m}_low"))])
    told = [F.struct(F.lit(m).alias("metric"), F.round(f"{m}_mean", 3).alias("mean"), F.round(100.0 * F.col(f"{m}_low") / F.col("n"), 0).alias("failing"), A.severity(m, F.col(f"{m}_mean")).alias("severity")) for m in A.GOALS]
    return wide.select(F.explode(F.array(*told)).alias("t")).select("t.*")


_NOW = "0.05 * k AS temperature, 10 + 5 * k AS rerank_top_n, 2048 * (k + 1) AS max_tokens, 30 + 20 * k AS bm25_top_k, 40 AS dense_top_k, 30 + 5 * k AS fusion_top_k, 400 + 150 * k AS chunk_size, 100 AS chunk_overlap, 0.45 + 0.05 * k AS bm25_weight"
_CHANGES = (
    ("faithfulness", 0.8, "temperature", "temperature", "CASE WHEN temperature > 0.05 THEN greatest(0, temperature - 0.05) ELSE 0 END"), ("faithfulness", 0.8, "rerank_top_n", "rerank_top_n", "least(rerank_top_n + 5, 25)"),
    ("relevancy", 0.75, "max_tokens", "max_tokens", "greatest(max_tokens, 4096)"), ("recall", 0.7, "bm25_top_k", "bm25_top_k", "least(bm25_top_k + 20, 80)"), ("recall", 0.7, "dense_top_k", "dense_top_k", "least(dense_top_k + 20, 80)"),
    ("recall", 0.7, "fusion_top_k", "fusion_top_k", "least(fusion_top_k + 10, 50)"), ("recall", 0.7, "chunk_size", "chunk_size", "CASE WHEN chunk_size > 500 THEN greatest(chunk_size - 200, 300) ELSE chunk_size END"),
    ("recall", 0.7, "chunk_overlap", "chunk_overlap", "greatest(floor(CASE WHEN chunk_size > 500 THEN greatest(chunk_size - 200, 300) ELSE chunk_size END * 0.15), 50)"), ("recall", 0.7, "bm25_weight", "bm25_weight", "least(bm25_weight + 0.05, 0.60)"),
    ("recall", 0.7, "dense_weight", "1 - bm25_weight", "round(1 - least(bm25_weight + 0.05, 0.60), 2)"),
)


@query(f"WITH m AS (SELECT source, avg(faithfulness) AS faithfulness, avg(relevancy) AS relevancy, avg(recall) AS recall, count(*) % 4 AS k FROM ({_SCORES}) GROUP BY source), s AS (SELECT *, {_NOW} FROM m) " + " UNION ALL ".join(f"SELECT source, '{m}' AS metric, '{p}' AS param, round(({now})::DOUBLE, 4) AS current, round(({then})::DOUBLE, 4) AS suggested FROM s WHERE {m} < {t}" for m, t, p, now, then in _CHANGES))
def suggested_parameters(spark, sf_dir):
    """What each source's index should be set to, from its means and its settings."""
    means = _scores(spark, sf_dir).groupBy("source").agg(*[A.mean(m).alias(m) for m in A.GOALS], (F.count(F.lit(1)) % 4).alias("k"))
    now = means.selectExpr("*", *[x.strip() for x in _NOW.split(", ")])
    return A.suggestions(now, ["source"])


_ROWS = """(SELECT l.doc_id, d.lang, quality = 0 AS evasive, l.doc_id % 3 <> 0 AS right_volume, ['COUVERT', 'PARTIEL', 'NON_COUVERT'][(l.doc_id % 3 + 1)::INT] AS coverage,
CASE WHEN l.doc_id % 5 > 0 THEN (l.doc_id % 3)::INT END AS facts, CASE WHEN l.doc_id % 5 > 0 THEN (l.doc_id % 2 + 1)::INT END AS invention FROM labels l JOIN documents d USING (doc_id))"""


def _campaign(spark, sf_dir):
    """Rows of a campaign: every fifth has no judge's marks."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    coverage = F.element_at(F.array(F.lit("COUVERT"), F.lit("PARTIEL"), F.lit("NON_COUVERT")), (k % 3 + 1).cast("int"))
    judged = k % 5 > 0
    return rows.select("doc_id", "lang", (F.col("quality") == 0).alias("evasive"), (k % 3 != 0).alias("right_volume"), coverage.alias("coverage"), F.when(judged, (k % 3).cast("int")).alias("facts"), F.when(judged, (k % 2 + 1).cast("int")).alias("invention"))


@query(f"""SELECT coalesce(lang, 'all') AS project, count(*)::BIGINT AS cases, count(*) FILTER (evasive)::BIGINT AS evasive, count(*) FILTER (right_volume)::BIGINT AS right_volume, count(*) FILTER (coverage = 'COUVERT')::BIGINT AS covered,
count(*) FILTER (coverage = 'PARTIEL')::BIGINT AS partial, count(*) FILTER (coverage = 'NON_COUVERT')::BIGINT AS uncovered, count(facts)::BIGINT AS judged, round(avg(facts), 2) AS facts, round(avg(invention), 2) AS invention FROM {_ROWS} GROUP BY ROLLUP (lang)""")
def campaign_report(spark, sf_dir):
    """Each project and the total."""
    return A.campaign(_campaign(spark, sf_dir), "lang")


@query(f"SELECT doc_id, coalesce(facts <= 1 OR invention <= 1, false) OR facts IS NULL AS first FROM {_ROWS}")
def campaign_first_to_read(spark, sf_dir):
    return _campaign(spark, sf_dir).select("doc_id", A.read_first(F.col("facts"), F.col("invention")).alias("first"))


@query("""WITH a AS (SELECT doc_id, text, lang FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 0)
SELECT count(*)::BIGINT AS cases, count(*) FILTER (a.text IS NOT DISTINCT FROM b.text)::BIGINT AS same_text, count(*) FILTER (a.lang IS NOT DISTINCT FROM b.lang)::BIGINT AS same_lang FROM a JOIN b USING (doc_id)""")
def campaign_compare(spark, sf_dir):
    """Two runs cell by cell: the second lacks cases and has other answers for some."""
    a = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = F.col("doc_id")
    b = a.where(d % 7 != 0).select("doc_id", F.when(d % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(d % 6 != 0, F.col("lang")).alias("lang"))
    return A.compared(a, b, "doc_id", ["text", "lang"])


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id, q.label AS wanted, v.label, v.vec_id AS other, round(list_dot_product(v.embedding::DOUBLE[], q.e) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM q, embeddings v WHERE v.vec_id <> q.vec_id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) <= 5) SELECT wanted AS label, round(avg(hit), 4) AS recall FROM (SELECT vec_id, wanted, max(CASE WHEN label = wanted THEN 1.0 ELSE 0.0 END) AS hit FROM t GROUP BY ALL) GROUP BY wanted""")
def recall_at_k(spark, sf_dir):
    """Share of questions with a row of their label among their five nearest others."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    near = R.dense(v, q, 6).where("vec_id <> qid")
    best = R.top(near, "qid", "vec_id", 5)
    wanted = v.select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    hits = best.join(v.select("vec_id", "label"), "vec_id").join(wanted, "qid").groupBy("qid", "wanted").agg(F.max((F.col("label") == F.col("wanted")).cast("double")).alias("hit"))
    return hits.groupBy(F.col("wanted").alias("label")).agg(F.round(F.avg("hit"), 4).alias("recall"))


@query("SELECT source, count(*)::BIGINT AS n FROM (SELECT DISTINCT source, lang, doc_id % 10 AS question FROM documents) GROUP BY source")
def passage_frequency(spark, sf_dir):
    """In how many answers a passage is used."""
    used = table(spark, sf_dir, "documents").select("source", "lang", (F.col("doc_id") % 10).alias("question")).distinct()
    return used.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(relevancy), 6) AS relevancy, round(avg(recall), 6) AS recall, count(*)::BIGINT AS n FROM (SELECT s.*, e.ts FROM ({_SCORES.replace('SELECT d.source', 'SELECT l.doc_id, d.source')}) s JOIN events e ON e.event_id = s.doc_id) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def eval_summary(spark, sf_dir):
    """All scores of the last thirty days in one row."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    scores = rows.select("doc_id", F.when(k % 9 != 0, (k % 10) / F.lit(10.0)).alias("faithfulness"), ((k % 7) / F.lit(7.0)).alias("relevancy"), F.col("quality").cast("double").alias("recall"))
    log = _log(spark, sf_dir).select(F.col("event_id").alias("doc_id"), "ts")
    newest = log.agg(F.max("ts").alias("now"))
    recent = scores.join(log, "doc_id").crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 30 DAY"))
    return A.averages(recent, ["faithfulness", "relevancy", "recall"], 6)


@query("SELECT event_type, count(value) AS n FROM events GROUP BY event_type")
def latency_counts(spark, sf_dir):
    return A.percentiles(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n")


@query()
def latency_percentiles(spark, sf_dir):
    """Medians and 95th percentiles within a ten-thousandth of the ranks, in bounded memory; checked by a unit test."""
    return A.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH q AS (SELECT doc_id, unnest(range(1, 4)) AS k FROM documents), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT count(*) AS n FROM embeddings)
SELECT d.source, round(avg(greatest(0, list_cosine_similarity(a.e, b.e))), 4) AS mean FROM q JOIN documents d USING (doc_id) JOIN e a ON a.vec_id = doc_id JOIN e b ON b.vec_id = (doc_id * 7 + k * 13) % (SELECT n FROM m) GROUP BY d.source""")
def mean_question_cosine(spark, sf_dir):
    """Mean cosine, cut at 0, of each row's vector and those of three generated questions."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    asked = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).crossJoin(F.broadcast(n))  # one row
    made = asked.select("doc_id", "source", ((F.col("doc_id") * 7 + F.col("k") * 13) % F.col("n")).alias("vec_id")).join(v.withColumnRenamed("e", "b"), "vec_id").drop("vec_id")
    rows = made.join(v.select(F.col("vec_id").alias("doc_id"), F.col("e").alias("a")), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg(F.greatest(F.lit(0.0), T.cosine(F.col("a"), F.col("b")))), 4).alias("mean"))
