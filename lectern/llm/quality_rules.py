"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Spark SQL expression; no user functions run. The rules are data: each row
of ``RULES`` names a ratio, the range it must lie in and the fewest words for which it counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be by this from or an at not "
    "le la les de des du et en un une que qui dans pour par sur au aux avec est pas "
    "der die das und zu den von mit ist nicht ein eine im auf dem sich "
    "el los las y del se con por para su una es lo al"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    ratio: str
    low: float
    high: float
    least_words: int = 10


#: The thresholds. ``ratio`` is SQL over the measures of :func:`measured`.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / word_chars", 0.0, 0.08),
    Rule("shouting", "n_bangs / n_words", 0.0, 0.2),
    Rule("upper_case", "n_upper / word_chars", 0.0, 0.5),
    Rule("stop_words", "n_stop_words / n_words", 0.03, 0.95, 30),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.0, 0.3, 200),
    Rule("line_length", "n_words / n_lines", 1.5, 1e9, 60),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the other measures, as longs.

    Windows of five words are compared by a 64-bit hash of the five strings. Columns of
    ``docs`` with names of measures are replaced; temporary columns start with ``_q_``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, h, windows, order = F.col("_q_words"), F.col("_q_hashes"), F.col("_q_windows"), F.col("_q_order")
    df = docs.withColumn("_q_text", body)
    df = df.withColumns({
        "_q_words": F.array_remove(F.split("_q_text", "[ \t-\r]+"), ""),
        "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike("[^ \t-\r]")),
        "_q_marks": F.regexp_replace("_q_text", "[^#*$%&|<>A-Z]+", ""),
        "n_bangs": F.expr("(length(_q_text) - length(replace(_q_text, '!!', ''))) div 2").cast("long"),
    })
    df = df.withColumns({
        "n_symbols": F.length(F.regexp_replace("_q_marks", "[A-Z]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace("_q_marks", "[^A-Z]+", "")).cast("long"),
        "n_words": F.size(words).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_hashes": F.when(F.size(words) >= 5, F.transform(words, lambda w: F.xxhash64(w))),
    })
    # Windows of 5 words as (2 words, next 2 words, fifth word); the padding at the end is cut off.
    rest = lambda x, k: F.slice(x, k, F.size(h))
    both = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("_q_windows", F.zip_with(h, rest(h, 2), both))
    df = df.withColumn("_q_windows", F.zip_with(windows, rest(windows, 3), both))
    df = df.withColumn("_q_windows", F.slice(F.zip_with(windows, rest(h, 5), both), F.lit(1), F.size(h) - 4))
    # Most texts repeat no window: one look at the distinct count spares them the sort.
    df = df.withColumn("_q_order", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get(order, j)["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter(order, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(at, start, step)["n"], F.lit(0)).cast("long"))
    return df.drop("_q_text", "_q_words", "_q_lines", "_q_marks", "_q_hashes", "_q_windows", "_q_order")


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a measured row breaks, joined by commas, in the table's order."""
    said = []
    for r in rules:
        above, below = r.ratio.split(" / ")
        ratio = F.expr(f"{above} * 1.0D / nullif({below}, 0)")
        said.append(F.when((F.col("n_words") >= r.least_words) & ~ratio.between(r.low, r.high), F.lit(r.name)))
    return F.concat_ws(",", *said)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, ``failed_rules`` and ``kept`` for every row of ``docs``, in one narrow projection.

    Null and empty texts have no words and so fail the base rule. Rows are judged one by one:
    repeated rows and ids each keep their row, an empty table gives an empty table, and other
    columns pass through (those with names of measures or verdicts are replaced).
    """
    df = measured(docs, text).withColumns({"base_failed": base_failed(), "failed_rules": failures(rules)})
    # The id is never below 0. It keeps a later filter on ``kept`` above this projection: pushed
    # below, the filter would hold all measures written out, one inside the other.
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "") & (F.monotonically_increasing_id() >= 0))
