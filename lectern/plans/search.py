"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import retrieval as R
from ..operators.shared import new_folder, once
from ..operators.term_index import TermIndex
from ..operators.vector_index import CellIndex
from .registry import query, table
from .text import files

_TERMS = "list_filter(regexp_split_to_array(replace(strip_accents(lower({})), '’', ''''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in R.FRENCH_STOP_WORDS)


def _once(words: str, endings: tuple) -> str:
    whens = " ".join(f"WHEN length(x.w) > {n} AND ends_with(x.w, '{old}') THEN struct_pack(w := left(x.w, length(x.w) - {len(old)}) || '{new}', done := true)" for n, old, new in endings)
    return f"list_transform({words}, lambda x: CASE WHEN x.done THEN x {whens} ELSE x END)"


def _each(words: str, endings: tuple) -> str:
    for n, old, new in endings:
        words = f"list_transform({words}, lambda x: CASE WHEN NOT x.done AND length(x.w) > {n} AND ends_with(x.w, '{old}') THEN struct_pack(w := left(x.w, length(x.w) - {len(old)}) || '{new}', done := false) ELSE x END)"
    return words


def _stems(words: str) -> str:
    """The stemmer's stages as lists, one after another."""
    change = lambda ws, test, new: f"list_transform({ws}, lambda x: CASE WHEN {test} THEN {new} ELSE x END)"
    ws = f"list_transform({words}, lambda x: CASE WHEN length(x) > 5 AND regexp_matches(x, '[^e]aux$') THEN left(x, length(x) - 2) || 'l' WHEN length(x) > 5 AND ends_with(x, 'x') THEN left(x, length(x) - 1) ELSE x END)"
    for c in "xs":
        ws = change(ws, f"length(x) > 3 AND ends_with(x, '{c}')", "left(x, length(x) - 1)")
    ws = f"list_transform({ws}, lambda x: struct_pack(w := x, done := false))"
    ws = _once(_each(_once(_each(_once(ws, R.FIRST_ENDINGS), R.BEFORE_SECOND), R.SECOND_ENDINGS), R.BEFORE_THIRD), R.THIRD_ENDINGS)
    ws = f"list_transform({ws}, lambda x: CASE WHEN length(x.w) > 4 THEN translate(x.w, '{R.FRENCH_ACCENTS[0]}', '{R.FRENCH_ACCENTS[1]}') ELSE x.w END)"
    single = "array_to_string(list_filter(string_split(x, ''), lambda c, i: i = 1 OR c <> x[i - 1] OR NOT regexp_matches(c, '\\p{{L}}')), '')"
    ws = change(ws, "length(x) > 4", single)
    ws = change(ws, "length(x) > 4 AND ends_with(x, 'ie')", "left(x, length(x) - 2)")
    return change(ws, "length(x) > 4", "regexp_replace(x, 'e?e?r?$', '')")


_LOW = "replace(replace(lower({}), '’', ''''), '‘', '''')"
_BARE = f"regexp_replace({_LOW}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Mn}}}}])({'|'.join(R.ELISIONS)})''', '\\1', 'g')"
_KEPT = f"list_filter(regexp_split_to_array({_BARE}, '[^\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Mn}}}}]+'), lambda x: x <> '' AND strip_accents(x) NOT IN ({_STOP}))"
_FRENCH = f"list_filter(list_transform({_stems(_KEPT)}, lambda x: strip_accents(x)), lambda x: x <> '')"


def _bm25(where: str = "", name: str = "scored", docs: str = "documents", terms: str = _TERMS, asked: str = "") -> str:
    """SQL for ``name`` (item_id, doc_id, score). ``asked`` replaces the question's terms by rows of item_id, t and share."""
    return f"""d_{name} AS MATERIALIZED (SELECT doc_id, {terms.format('text')} AS w FROM {docs} {where}), s_{name} AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d_{name} WHERE len(w) > 0),
q_{name} AS ({asked or f"SELECT item_id, unnest(list_distinct({terms.format('text')})) AS t, 1.0::DOUBLE AS share FROM benchmark"}), tf_{name} AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d_{name}) WHERE t IN (SELECT t FROM q_{name}) GROUP BY ALL),
df_{name} AS (SELECT t, count(*)::DOUBLE AS df FROM tf_{name} GROUP BY t),
{name} AS (SELECT q.item_id, tf.doc_id, round(sum(share * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / a))), 6) AS score FROM q_{name} q JOIN tf_{name} tf USING (t) JOIN df_{name} USING (t) JOIN d_{name} d ON d.doc_id = tf.doc_id, s_{name} GROUP BY ALL)"""


def _ranked(name: str, qid: str, key: str, k: int) -> str:
    return f"r_{name} AS (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, {key}) AS rank FROM {name} QUALIFY rank <= {k})"


_COS = "round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6)"


def _dense(where: str = "", name: str = "near") -> str:
    return f"v_{name} AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings {where}), q_{name} AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), {name} AS (SELECT q.qid, v.vec_id, {_COS} AS score FROM v_{name} v, q_{name} q)"


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


def _texts(spark, sf_dir) -> TermIndex:
    """The documents' index, made once in a session for all queries that search them."""
    docs = table(spark, sf_dir, "documents")
    return TermIndex(spark, once(docs, "document-terms", lambda folder: TermIndex.build(docs, {"text": R.terms(F.col("text"))}, "doc_id", folder)))


def _lexical(spark, sf_dir):
    """The best 40 documents of every benchmark question."""
    return R.top(R.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), k=40, index=_texts(spark, sf_dir)), "item_id", "doc_id", 40)


@query(f"WITH {_bm25()}, {_ranked('scored', 'item_id', 'doc_id', 40)} SELECT item_id, doc_id, score, rank::INT AS rank FROM r_scored")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir)


@query(f"WITH {_bm25(chr(87) + 'HERE lang = ' + chr(39) + 'fr' + chr(39))}, {_ranked('scored', 'item_id', 'doc_id', 40)} SELECT item_id, doc_id, score, rank::INT AS rank FROM r_scored")
def bm25_filtered(spark, sf_dir):
    """The facet filter comes before the top-k."""
    return R.top(R.bm25(R.facet_filter(table(spark, sf_dir, "documents"), {"lang": "fr"}), _questions(spark, sf_dir), k=40), "item_id", "doc_id", 40)


_NAMES = "(SELECT doc_id, 'doc_' || doc_id || '.txt' AS text FROM documents)"
_CONTEXTS = "(SELECT doc_id, '[Fichier: doc_' || doc_id || '.txt | Chemin: ' || source || '/' || lang || ' | Type: TXT]' || chr(10) || text AS text FROM documents)"
_TITLES = "(SELECT doc_id, source || ' ' || lang AS text FROM documents)"
_BEST = f"""WITH {_bm25(name='body', terms=_FRENCH)}, {_bm25(name='context', docs=_CONTEXTS, terms=_FRENCH)}, {_bm25(name='name', docs=_NAMES)}, {_bm25(name='title', docs=_TITLES, terms=_FRENCH)},
scored AS (SELECT item_id, doc_id, round(max(score), 4) AS score FROM (SELECT item_id, doc_id, 3 * score AS score FROM body UNION ALL SELECT item_id, doc_id, 2 * score FROM context UNION ALL SELECT item_id, doc_id, 2 * score FROM name UNION ALL SELECT item_id, doc_id, 2 * score FROM title) GROUP BY ALL)"""


def _index(spark, sf_dir):
    """Documents as index rows with all searched fields."""
    rows = files(spark, sf_dir)
    context = T.file_context(F.col("file_name"), F.col("file_path"), F.lit("txt"))
    return rows.withColumns({"text_with_context": F.concat(context, F.lit("\n"), "text"), "title": F.concat_ws(" ", "source", "lang"), "author": F.lit("")})


@query(_BEST + " SELECT item_id, count(*)::BIGINT AS n, round(max(score), 2) AS best, round(sum(score) / count(*), 2) AS mean FROM scored GROUP BY item_id")
def bm25_multifield(spark, sf_dir):
    """Six fields, each with its own analysis, statistics and boost; the best one counts. Summed up by question."""
    scored = R.search(_index(spark, sf_dir), _questions(spark, sf_dir)).withColumn("score", F.round("score", 4))
    return scored.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 2).alias("best"), F.round(F.sum("score") / F.count(F.lit(1)), 2).alias("mean"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_FRENCH.format('text')})), ' ') AS terms FROM documents")
def french_analysis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(R.french_terms(F.col("text")))), " ").alias("terms"))


@query("SELECT doc_id, '/' || source || ',/' || source || '/' || lang || ',/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS paths FROM documents")
def path_analysis(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.array_join(R.path_terms(F.col("file_path")), ",").alias("paths"))


#: DuckDB counts edits in bytes: letters beyond ASCII stand as one byte each.
_BYTES = "translate({}, 'ßœæøđłıħþð', '!#$%&()*+-')"
_LEV = f"levenshtein({_BYTES.format('t')}, {_BYTES.format('term')})"
_DL = f"damerau_levenshtein({_BYTES.format('t')}, {_BYTES.format('term')})"
#: Optimal string alignment, row by row; DuckDB's own distance also edits letters that it has swapped.
_NEXT = "least(p.one[y.j + 1] + 1, q.r[y.j] + 1, p.one[y.j] + (substr(t, x.i, 1) <> substr(term, y.j, 1))::INT, CASE WHEN x.i > 1 AND y.j > 1 AND substr(t, x.i, 1) = substr(term, y.j - 1, 1) AND substr(t, x.i - 1, 1) = substr(term, y.j, 1) THEN p.two[y.j - 1] + 1 ELSE 99 END)"
_ROW = f"list_reduce(list_prepend({{'j': 0, 'r': [x.i]}}, list_transform(range(1, length(term) + 1), lambda j: {{'j': j::INT, 'r': []::INT[]}})), lambda q, y: {{'j': y.j, 'r': list_append(q.r, {_NEXT})}}).r"
_OSA = f"list_reduce(list_prepend({{'i': 0, 'two': []::INT[], 'one': range(length(term) + 1)::INT[]}}, list_transform(range(1, length(t) + 1), lambda i: {{'i': i::INT, 'two': []::INT[], 'one': []::INT[]}})), lambda p, x: {{'i': x.i, 'two': p.one, 'one': {_ROW}}}).one[-1]"
_ALLOWED = "CASE WHEN length(t) <= 2 THEN 0 WHEN length(t) <= 5 THEN 1 ELSE 2 END"
_EXPANDED = f"""q AS (SELECT item_id, unnest(list_distinct({_TERMS.format('text')})) AS t FROM benchmark), v AS (SELECT DISTINCT unnest(list_distinct({_TERMS.format('text')})) AS term FROM documents),
b AS MATERIALIZED (SELECT t, term, {_LEV} AS lev, {_DL} AS dl FROM (SELECT DISTINCT t FROM q) JOIN v ON substr(t, 1, 2) = substr(term, 1, 2) AND abs(length(t) - length(term)) <= 2 WHERE {_DL} <= {_ALLOWED}),
c AS (SELECT t, term, dl::INT AS distance FROM b WHERE dl = lev OR dl < 2 UNION ALL SELECT t, term, {_OSA} FROM b WHERE dl < lev AND dl >= 2 AND {_OSA} <= {_ALLOWED}),
x AS (SELECT t, term, distance FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY distance, term) <= 10)"""


@query(f"WITH {_EXPANDED} SELECT t, term, distance FROM x")
def bm25_fuzzy(spark, sf_dir):
    """Question terms expanded by vocabulary terms with the same two first letters at an edit distance that the length allows, swaps as one edit; ten for each."""
    field = F.lit("text").alias("field")
    asked = _questions(spark, sf_dir).select(field, F.explode(R.terms(F.col("text"))).alias("term")).distinct()
    vocabulary = _texts(spark, sf_dir).rows.where("term <> ''").select("field", "term").distinct()
    return R.expanded(asked, vocabulary).select(F.col("term").alias("t"), F.col("found").alias("term"), "distance")


_SHARES = f"WITH {_EXPANDED} SELECT item_id, x.term AS t, 1 - distance::DOUBLE / least(length(x.t), length(x.term)) AS share FROM q JOIN x ON q.t = x.t"


@query(f"WITH {_bm25(asked=_SHARES)}, {_ranked('scored', 'item_id', 'doc_id', 40)} SELECT item_id, doc_id, score, rank::INT AS rank FROM r_scored")
def bm25_fuzzy_topk(spark, sf_dir):
    """Near terms are searched too and count for less."""
    field = R.Field("text", 1.0, R.terms)
    return R.top(R.search(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), (field,), fuzzy=True, k=40, index=_texts(spark, sf_dir)), "item_id", "doc_id", 40)


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(f"WITH {_dense()}, {_ranked('near', 'qid', 'vec_id', 40)} SELECT qid, vec_id, score, rank::INT AS rank FROM r_near")
def dense_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.top(R.dense(v, q, 40), "qid", "vec_id", 40)


@query(f"WITH {_dense('WHERE label IN (1, 2)')}, {_ranked('near', 'qid', 'vec_id', 40)} SELECT qid, vec_id, score, rank::INT AS rank FROM r_near")
def dense_filtered(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.top(R.dense(R.facet_filter(v, {"label": [1, 2]}), q, 40), "qid", "vec_id", 40)


@query()
def ann_topk(spark, sf_dir):
    """Every twentieth vector against an index of all of them; each question reads its nearest cells only. Checked by recall and by the exact scores in a test."""
    v, q = _vectors(spark, sf_dir)
    return R.top(CellIndex.build(v, new_folder(spark, "cell-index")).search(q, 40), "qid", "vec_id", 40)


@query()
def ann_recall(spark, sf_dir):
    """For every question the share of its exact 40 nearest that the index finds."""
    v, q = _vectors(spark, sf_dir)
    found = ann_topk(spark, sf_dir).select("qid", "vec_id", F.lit(1).alias("_hit"))
    exact = R.top(R.dense(v, q, 40), "qid", "vec_id", 40).select("qid", "vec_id")
    return exact.join(found, ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("_hit").alias("found"), F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))


_HYBRID = f"""WITH {_bm25()}, {_ranked('scored', 'item_id', 'doc_id', 40)}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), near AS (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, {_COS} AS score FROM v, v q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
{_ranked('near', 'item_id', 'doc_id', 40)},
f AS (SELECT item_id, doc_id, a.rank AS lr, b.rank AS dr, round(coalesce(0.45::DOUBLE / (60 + a.rank), 0) + coalesce(0.55::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM r_scored a FULL JOIN r_near b USING (item_id, doc_id)),
fused AS (SELECT item_id, doc_id, lr, dr, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, coalesce(lr, dr + 1000000000)) AS rank FROM f)"""


def hybrid(spark, sf_dir):
    """Both ranked lists of every benchmark question, fused. The question's vector is the one of the same number."""
    lexical = _lexical(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.withColumnRenamed("doc_id", "item_id").join(_questions(spark, sf_dir).select("item_id"), "item_id", "left_semi")
    near = R.top(R.dense(v, q, 40, "doc_id", "item_id"), "item_id", "doc_id", 40)
    return R.fuse(lexical, near, "item_id", "doc_id")


@query(_HYBRID + " SELECT item_id, doc_id, lr::INT AS lexical_rank, dr::INT AS dense_rank, rrf, rank::INT AS rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return hybrid(spark, sf_dir)


@query(_HYBRID + " SELECT * FROM (SELECT item_id // 4 AS question, doc_id, max(rrf) AS rrf FROM fused GROUP BY item_id // 4, doc_id) QUALIFY row_number() OVER (PARTITION BY question ORDER BY rrf DESC, doc_id) <= 20")
def hybrid_multi_query(spark, sf_dir):
    """Four variants of a question each: the best fused score of every document counts."""
    best = hybrid(spark, sf_dir).groupBy(F.floor(F.col("item_id") / 4).alias("question"), "doc_id").agg(F.max("rrf").alias("rrf"))
    w = Window.partitionBy("question").orderBy(F.desc("rrf"), "doc_id")
    return best.withColumn("n", F.row_number().over(w)).where("n <= 20").drop("n")


@query(_HYBRID + " SELECT item_id, count(*)::BIGINT AS fused, count(lr)::BIGINT AS lexical, count(dr)::BIGINT AS dense, (count(lr) + count(dr) - count(*))::BIGINT AS both_lists FROM fused GROUP BY ALL")
def hybrid_details(spark, sf_dir):
    n = lambda c: F.count(c)
    return hybrid(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("fused"), n("lexical_rank").alias("lexical"), n("dense_rank").alias("dense"), (n("lexical_rank") + n("dense_rank") - F.count(F.lit(1))).alias("both_lists"))


_CAPPED = _HYBRID + """, j AS (SELECT f.item_id, f.doc_id, f.rank, f.rrf, d.source, d.lang FROM fused f JOIN documents d USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, source IN ('src0', 'src1') ORDER BY rank) AS nth FROM j), k AS (SELECT * FROM n WHERE source NOT IN ('src0', 'src1') OR nth <= 2),
lot AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM k QUALIFY place <= 10)"""


def lot(spark, sf_dir):
    """The passages that answer a question: no tables of contents, two secondary ones at most, ten in all. Texts are reduced to what the walk asks of them before the join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", T.is_contents_page(F.col("text")).alias("contents"))
    ranked = hybrid(spark, sf_dir).join(docs, "doc_id")
    return R.capped(ranked, "item_id", F.col("source").isin("src0", "src1"), F.col("contents"), 2, 10)


@query(_CAPPED + " SELECT item_id, doc_id, place::INT AS place FROM lot")
def secondary_cap(spark, sf_dir):
    return lot(spark, sf_dir).select("item_id", "doc_id", "place")


@query(_CAPPED + " SELECT item_id, sha256(string_agg('[Source: doc_' || lot.doc_id || '.txt]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context FROM lot JOIN documents USING (doc_id) GROUP BY item_id")
def context_assembly(spark, sf_dir):
    said = F.concat(F.lit("[Source: doc_"), "doc_id", F.lit(".txt]\n"), "text")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = lot(spark, sf_dir).join(texts, "doc_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("p"))  # ten passages
    return parts.select("item_id", F.sha2(F.array_join(F.transform("p", lambda x: x["said"]), "\n\n---\n\n"), 256).alias("context"))


@query(_CAPPED + " SELECT item_id, source, lang, min(place)::INT AS place, round(max_by(rrf, -place), 4) AS score FROM lot GROUP BY item_id, source, lang")
def source_dedupe(spark, sf_dir):
    """Sources of an answer: each place of origin once, by its best passage."""
    return lot(spark, sf_dir).groupBy("item_id", "source", "lang").agg(F.min("place").alias("place"), F.round(F.min_by("rrf", "place"), 4).alias("score"))


@query(_CAPPED + " SELECT item_id, place::INT AS place, 'doc_' || doc_id || '.txt' AS file_name, length(substr(text, 1, 1000))::BIGINT AS chars, round(rrf, 4) AS score FROM lot JOIN documents USING (doc_id)")
def passage_projection(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lot(spark, sf_dir).join(texts, "doc_id").select("item_id", "place", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("file_name"), F.length(F.substring("text", 1, 1000)).cast("long").alias("chars"), F.round("rrf", 4).alias("score"))


@query(_HYBRID + f""", r AS (SELECT f.item_id, f.doc_id, f.rank, len(list_intersect(list_distinct({_TERMS.format('b.text')}), list_distinct({_TERMS.format('d.text')})))::DOUBLE / len(list_distinct({_TERMS.format('b.text')})) AS s FROM fused f JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))
SELECT item_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, rank)::INT AS place FROM r QUALIFY place <= 10""")
def rerank_stub(spark, sf_dir):
    """Pairs scored by a stand-in model (share of the question's terms), best first, equal ones in the order they came."""
    q = _questions(spark, sf_dir).select("item_id", F.col("text").alias("asked"))
    fused = hybrid(spark, sf_dir)
    pairs = fused.join(table(spark, sf_dir, "documents"), "doc_id").join(q, "item_id")
    scores = pairs.select("item_id", "doc_id", R.overlap(F.col("asked"), F.col("text")).alias("score"))
    return R.funnel(fused, scores, "item_id", "doc_id", R.DEEP.with_(search=1000, fusion=1000, rerank=10)).select("item_id", "doc_id", "score", "place")


_HITS = """(SELECT conv_id, turn, text, 'd' || turn % 4 || '.pdf' AS file_name, CASE WHEN turn % 2 = 0 THEN '/p/d' || turn % 4 || '.pdf' ELSE '' END AS file_path, (turn % 3)::INT AS page_start, (turn % 3 + 1)::INT AS page_end,
CASE WHEN turn % 5 = 0 THEN 0 END::INT AS page, CASE WHEN turn % 2 = 0 THEN turn / 7.0 END::DOUBLE AS rerank_score, CASE WHEN turn % 3 = 0 THEN turn / 9.0 END::DOUBLE AS rrf_score, (turn / 11.0)::DOUBLE AS score FROM conversations)"""


def _hits(spark, sf_dir):
    t = F.col("turn")
    name = F.concat(F.lit("d"), t % 4, F.lit(".pdf"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", name.alias("file_name"), F.when(t % 2 == 0, F.concat(F.lit("/p/"), name)).otherwise(F.lit("")).alias("file_path"), (t % 3).cast("int").alias("page_start"), (t % 3 + 1).cast("int").alias("page_end"),
        F.when(t % 5 == 0, F.lit(0)).alias("page"), F.when(t % 2 == 0, t / F.lit(7.0)).alias("rerank_score"), F.when(t % 3 == 0, t / F.lit(9.0)).alias("rrf_score"), (t / F.lit(11.0)).alias("score"),
    )


@query(f"SELECT conv_id, turn, file_name, substr(text, 1, 1000) AS text, round(coalesce(rerank_score, rrf_score, score), 4) AS score, coalesce(page, page_start) AS page, coalesce(page, page_end) AS last_page FROM {_HITS} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 30")
def projected_hits(spark, sf_dir):
    """Turns as ranked hits."""
    return R.projected(_hits(spark, sf_dir), "conv_id", "turn")


@query(f"WITH f AS (SELECT * FROM {_HITS} QUALIFY row_number() OVER (PARTITION BY conv_id, CASE WHEN file_path = '' THEN file_name ELSE file_path END, page_start, page_end ORDER BY turn) = 1) SELECT conv_id, turn, round(score, 4) AS score FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10")
def distinct_sources(spark, sf_dir):
    return R.distinct_sources(_hits(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "score")


@query(_HYBRID + f""", c AS (SELECT * FROM fused WHERE rank <= 30), r AS (SELECT c.item_id, c.doc_id, c.rank, d.lang, round(len(list_intersect(list_distinct({_TERMS.format('b.text')}), list_distinct({_TERMS.format('d.text')})))::DOUBLE / len(list_distinct({_TERMS.format('b.text')})), 6) AS s FROM c JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, rank) AS spot FROM r) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY spot)::INT AS place FROM k WHERE lang <> 'de' QUALIFY place <= 15""")
def candidate_funnel(spark, sf_dir):
    """The first thirty of the fused list, reranked, without one language, the first fifteen."""
    fused = hybrid(spark, sf_dir)
    docs, q = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _questions(spark, sf_dir).select("item_id", F.col("text").alias("asked"))
    near = fused.where("rank <= 30").join(docs, "doc_id").join(q, "item_id")
    scores = near.select("item_id", "doc_id", "lang", R.overlap(F.col("asked"), F.col("text")).alias("score"))
    return R.funnel(fused, scores, "item_id", "doc_id", R.Profile(), F.col("lang") != "de").select("item_id", "doc_id", "place")


@query()
def stub_embeddings(spark, sf_dir):
    """Vectors of a stand-in encoder; checked by a unit test."""
    return R.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query("SELECT source AS title, count(*)::BIGINT AS n FROM documents GROUP BY source ORDER BY n DESC, title LIMIT 500")
def catalogue_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("title")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(500)


def flagship(spark, sf_dir):
    """Chunk, score chunks lexically for every question, fuse with the dense list of their documents, keep the best ten with context ids."""
    chunks = C.fixed(table(spark, sf_dir, "documents"), 1024, 150).select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt_chunk_"), "chunk_index").alias("chunk_id"), "doc_id", F.col("chunk").alias("text"))
    lexical = R.top(R.bm25(chunks, _questions(spark, sf_dir), key="chunk_id", k=40), "item_id", "chunk_id", 40)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.withColumnRenamed("doc_id", "item_id").join(_questions(spark, sf_dir).select("item_id"), "item_id", "left_semi")
    by_doc = R.top(R.dense(v, q, 40, "doc_id", "item_id"), "item_id", "doc_id", 40)
    near = by_doc.join(chunks.select("doc_id", "chunk_id"), "doc_id").select("item_id", "chunk_id", "score", (F.col("rank") * 1000).alias("rank"))
    return R.fuse(lexical, near, "item_id", "chunk_id").where("rank <= 10").withColumn("point_id", T.point_id(F.col("chunk_id")))
