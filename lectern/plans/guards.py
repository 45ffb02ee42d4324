"""Guard queries: ``conversations`` holds the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guards as G
from .registry import query, table

_DENY = "Le dossier ne mentionne pas ce point. "
_ANSWERS = f"(SELECT conv_id, turn, role, CASE conv_id % 3 WHEN 0 THEN '{_DENY}' || text WHEN 1 THEN text || ' Voir rapport.pdf page 12. {_DENY}' ELSE text END AS text FROM conversations)"


def _answers(spark, sf_dir):
    """Turns as answers: a third of them deny at the start, a third at the end with a citation."""
    t, k = F.col("text"), F.col("conv_id") % 3
    said = F.when(k == 0, F.concat(F.lit(_DENY), t)).when(k == 1, F.concat(t, F.lit(f" Voir rapport.pdf page 12. {_DENY}"))).otherwise(t)
    return table(spark, sf_dir, "conversations").withColumn("text", said)


def _first(pattern: str) -> str:
    """SQL for the place of the first match in ``p``, from 0, or -1."""
    bare = pattern.replace("(?i)", "").replace("'", "''")
    return f"CASE WHEN regexp_matches(p, '(?i){bare}') THEN length(regexp_extract(p, '(?is)^(.*?)(?:{bare})', 1)) ELSE -1 END"


def _plain(pattern: str) -> str:
    return f"(SELECT conv_id, turn, role, text, p, {_first(pattern)} AS at_ FROM (SELECT conv_id, turn, role, text, strip_accents(text) AS p FROM {_ANSWERS}))"


@query(f"SELECT conv_id, turn, p = '' OR at_ >= 0 AND (at_ < 0.15 * length(p) OR length(p) < 700 OR NOT regexp_matches(p, '{G.CITATION}')) AS evasive FROM {_plain(G.ABSENCE)}")
def evasive_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", G.evasive(F.col("text")).alias("evasive"))


@query(f"SELECT conv_id, turn, CASE WHEN p = '' THEN 'ESQUIVE' WHEN at_ < 0 THEN 'repond' WHEN at_ / length(p) < 0.15 OR length(p) < 700 OR NOT regexp_matches(p, '{G.CITED_SOURCE}') THEN 'ESQUIVE' ELSE 'concede' END AS stance FROM {_plain(G.STANCE_ABSENCE)}")
def evasion_three_state(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", G.stance(F.col("text")).alias("stance"))


@query(r"""WITH l AS (SELECT doc_id, trim(lower(regexp_replace(strip_accents(regexp_replace(l, '^\s*(?:\d+[.)]|[-*•])\s*', '')), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
c AS (SELECT doc_id, l, count(*) AS n FROM l WHERE length(l) > 20 GROUP BY ALL), d AS (SELECT doc_id, sum(n) AS n, count(*) AS distinct_n, max(n) AS most FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(d.n >= 8 AND (d.distinct_n < 0.6 * d.n OR d.most >= 4), false) AS degenerate FROM documents LEFT JOIN d USING (doc_id)""")
def degenerate_answers(spark, sf_dir):
    return G.degenerate(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def numbers_outside(spark, sf_dir):
    """Numbers of every turn, with some of no passage, that the passage lacks, which in every third conversation has none of the turn's own; checked row by row by a unit test, as RE2 has no look-behind."""
    text = F.coalesce("text", F.lit(""))
    answer = F.concat(text, F.lit("\n1. 2 830 m (page 99) et 0,80"), F.when(F.col("turn") % 2 == 1, F.lit(", 4567 ha")).otherwise(F.lit("")))
    passage = F.concat(F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(text), F.lit(" 2830 et 0.8"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(G.unsupported_numbers(answer, passage), ",").alias("outside"))


@query()
def pages_outside(spark, sf_dir):
    """Cited pages of every turn outside the pages 1 to 6; checked row by row by a unit test."""
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" (page "), "turn", F.lit(")"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(G.unsupported_pages(answer, F.sequence(F.lit(1), F.lit(6))), ",").alias("outside"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, turn, length(text) % 9 AS page, CASE WHEN turn % 2 = 0 THEN 'etude.pdf' ELSE 'rnt.pdf' END AS cited, CASE WHEN turn % 2 = 0 THEN n ELSE 2 * n END AS last FROM conversations JOIN n USING (conv_id))
SELECT conv_id, turn, CASE WHEN page BETWEEN 1 AND last THEN '' ELSE cited || ' p. ' || page END AS outside FROM b""")
def pages_outside_files(spark, sf_dir):
    """Every turn, with its own text, cites a page of one of its conversation's two files, which have a page and two pages for each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.struct("conv_id", "turn").alias("k"))
    name = F.when(F.col("turn") % 2 == 0, F.lit("etude.pdf")).otherwise(F.lit("rnt.pdf"))
    answers = turns.select("k", F.concat("text", F.lit(" Le dossier Etude.pdf et d'autres. Selon "), name, F.lit(", page "), F.length("text") % 9, F.lit(", c'est ainsi.")).alias("text"))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    files = F.array(F.struct(F.lit("Etude.pdf").alias("file_name"), F.col("n").alias("n")), F.struct(F.lit("rnt.pdf").alias("file_name"), (2 * F.col("n")).alias("n")))
    lots = turns.join(sizes, "conv_id").select("k", F.explode(files).alias("f")).select("k", "f.file_name", F.explode(F.sequence(F.lit(1), F.col("f.n"))).alias("page"))
    return G.pages_outside_files(answers, lots, "k", "text").select("k.conv_id", "k.turn", F.array_join("outside", ",").alias("outside"))


def retention_rows(spark, sf_dir):
    """``conv_id, turn, lot, there, blocks, synthesis``: the lot (``there``: its numbers) is the conversation with some figures, the blocks are each turn's own text with some of these, the synthesis keeps text and figures, text and one figure, or nothing."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    lots = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("said"))  # one conversation
    area = (F.col("conv_id") + 1000).cast("string")
    lots = lots.select("conv_id", F.concat("said", F.lit("\nLa surface est de "), area, F.lit(" ha, la hauteur de 0.75 m.")).alias("lot"))
    rows = turns.join(lots.withColumn("there", T.numbers(F.col("lot"))), "conv_id")
    blocks = F.concat(F.lit("# Bloc\n- "), "text", F.lit("\n- surface "), area, F.lit(" ha\n- hauteur **0,750 m** selon page 77"))
    kept = F.element_at(F.array(F.concat("text", F.lit(" "), area, F.lit(" ha et 0,75 m")), F.concat("text", F.lit(" "), area), F.lit("Rien.")), (F.col("turn") % 3 + 1).cast("int"))
    return rows.select("conv_id", "turn", "lot", "there", blocks.alias("blocks"), kept.alias("synthesis"))


@query()
def data_retention(spark, sf_dir):
    """What of each turn's names and numbers a synthesis keeps; row by row by a unit test."""
    r = retention_rows(spark, sf_dir).select("conv_id", "turn", G.retention(F.col("synthesis"), F.col("blocks"), F.col("lot"), there=F.col("there")).alias("r"))
    return r.select("conv_id", "turn", "r.rate", F.array_join("r.missing", ",").alias("missing"), F.array_join("r.lines", "|").alias("lines"))


@query("SELECT conv_id, turn, CASE WHEN p = '' OR at_ >= 0 AND (at_ < 0.15 * length(p) OR length(p) < 700 OR NOT regexp_matches(p, '{1}')) THEN 'deep' WHEN turn % 3 = 0 THEN 'again' ELSE 'none' END AS retry FROM {0}".format(_plain(G.ABSENCE), G.CITATION))
def block_with_guards(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    return rows.select("conv_id", "turn", G.block_flags(F.col("text"), F.lit("2830"), F.col("turn") % 3 == 0, F.lit(False))["retry"].alias("retry"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'internal' WHEN length(text) > 200 AND role = 'assistant' THEN 'long' WHEN turn % 2 = 0 THEN 'even' ELSE 'other' END AS route FROM conversations")
def rule_router(spark, sf_dir):
    """The first rule that holds names the route."""
    rules = [("internal", F.col("role") == "system"), ("long", (F.length("text") > 200) & (F.col("role") == "assistant")), ("even", F.col("turn") % 2 == 0)]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.routed(rules, "other").alias("route"))


_BLOCKS = rf"""(SELECT conv_id, p = '' OR at_ >= 0 AND (at_ < 0.15 * length(p) OR length(p) < 700 OR NOT regexp_matches(p, '{G.CITATION}')) AS evasive, length(text) >= 400 OR role = 'system' AS truncated,
list_transform(regexp_extract_all(text, '(?i)\b(?:pages?|p\.)\s*(\d{{1,4}})', 1), lambda x: x::INT::VARCHAR) AS pages FROM {_plain(G.ABSENCE)})"""


def _blocks(spark, sf_dir):
    """Answers with what the guards say of each: does it evade, was it cut (by its length or its reason), which pages does it cite."""
    reason = F.when(F.col("role") == "system", "length").otherwise("stop")
    return _answers(spark, sf_dir).select("conv_id", G.evasive(F.col("text")).alias("evasive"), G.truncated(reason, F.length("text"), 400).alias("truncated"), T.cited_pages(F.col("text")).alias("pages"))


@query(f"SELECT conv_id, bool_or(evasive) AS any_evasive, bool_or(truncated) AS any_truncated, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages FROM {_BLOCKS} GROUP BY conv_id")
def guard_rollup(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("conv_id").agg(F.bool_or("evasive").alias("any_evasive"), F.bool_or("truncated").alias("any_truncated"), F.array_join(F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("pages"))), lambda x: x.cast("string"))), ",").alias("pages"))


@query(f"""WITH v AS (SELECT conv_id, CASE WHEN bool_and(evasive) THEN 'NON_COUVERT' WHEN bool_or(truncated) OR bool_or(evasive) THEN 'PARTIEL' ELSE 'COUVERT' END AS v, bool_or(evasive)::INT + bool_or(truncated)::INT AS g FROM {_BLOCKS} GROUP BY conv_id)
SELECT conv_id, CASE v WHEN 'COUVERT' THEN 'SUFFISANT' WHEN 'NON_COUVERT' THEN 'INSUFFISANT' ELSE 'PARTIEL' END AS verdict, round(greatest(0.1, CASE v WHEN 'COUVERT' THEN 0.8 WHEN 'PARTIEL' THEN 0.5 ELSE 0.2 END - 0.1 * g), 2)::DOUBLE AS confidence FROM v""")
def verdict_confidence(spark, sf_dir):
    folded = _blocks(spark, sf_dir).groupBy("conv_id").agg(F.bool_and("evasive").alias("none"), F.bool_or("evasive").alias("e"), F.bool_or("truncated").alias("t"))
    verdict = F.when(F.col("none"), "NON_COUVERT").when(F.col("t") | F.col("e"), "PARTIEL").otherwise("COUVERT")
    return folded.select("conv_id", G.public_verdict(verdict).alias("verdict"), G.confidence(verdict, F.col("e").cast("int") + F.col("t").cast("int")).alias("confidence"))


@query("SELECT conv_id, sha256(string_agg('### ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS assembled FROM conversations GROUP BY conv_id")
def assemble_blocks(spark, sf_dir):
    said = F.concat(F.lit("### "), "turn", F.lit("\n"), "text")
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("p"))  # one conversation
    return parts.select("conv_id", F.sha2(F.array_join(F.transform("p", lambda x: x["said"]), "\n\n"), 256).alias("assembled"))


@query("SELECT conv_id, count(*)::BIGINT AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id")
def history_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))
    parts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("p"))
    return parts.select("conv_id", "n", F.array_join(F.transform("p", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT event_id, event_type = 'click' OR value >= 80 AS truncated, CASE WHEN value IS NOT NULL THEN least(100, round(100 * value / 4096, 2)) END AS fill FROM events")
def truncation_flags(spark, sf_dir):
    """An answer whose size is not known is cut only where its reason says so."""
    reason = F.when(F.col("event_type") == "click", "length").otherwise("stop")
    fill = F.when(F.col("value").isNotNull(), F.least(F.lit(100.0), F.round(100 * F.col("value") / 4096, 2)))
    return table(spark, sf_dir, "events").select("event_id", G.truncated(reason, F.col("value"), 80).alias("truncated"), fill.alias("fill"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 0 ELSE least(2, greatest(0, turn::INT - 2)) END AS mark FROM conversations")
def judge_clamp(spark, sf_dir):
    """Marks of a judge who quotes the turn's own text beside them; every fifth gives none."""
    name = F.when(F.col("turn") % 5 == 4, F.lit("autre")).otherwise(F.lit("faits"))
    quoted = F.to_json(F.struct(F.col("text").alias("remarque")))
    said = F.concat(F.lit('Note : {"'), name, F.lit('": '), F.col("turn") - 2, F.lit(', "cite": '), F.coalesce(quoted, F.lit("null")), F.lit("} fin"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.judge_mark(said, "faits").alias("mark"))


@query("SELECT role AS file_name, p AS page, count(*)::BIGINT AS n FROM (SELECT role, unnest(range(turn, turn + length(text) // 150 + 1)) AS p FROM conversations) GROUP BY ALL")
def lot_pages(spark, sf_dir):
    """The pages that a lot's passages cover, by file: a passage runs on over a page for each 150 characters."""
    pages = F.explode(F.sequence(F.col("turn"), F.col("turn") + F.floor(F.length("text") / 150)))
    return table(spark, sf_dir, "conversations").select(F.lower("role").alias("file_name"), pages.alias("page")).groupBy("file_name", "page").agg(F.count(F.lit(1)).alias("n"))
