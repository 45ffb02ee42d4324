"""Statistics of evaluations and campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a campaign's coverage may be, and up to which mark an answer is to be read first.
COVERAGES = {"covered": "COUVERT", "partial": "PARTIEL", "uncovered": "NON_COUVERT"}
LOW_MARK = 1
#: Ranks of a percentile are right within one part of so many.
ACCURACY = 10_000


def campaign(rows: DataFrame, project: str) -> DataFrame:
    """``project, cases, evasive, right_volume, covered, partial, uncovered, judged, facts, invention`` of each project and of all. ``rows``: ``project, evasive, right_volume, coverage, facts, invention``; rows without marks were not judged."""
    kinds = [F.count_if(F.col("coverage") == v).alias(k) for k, v in COVERAGES.items()]
    made = rows.rollup(project).agg(F.count(F.lit(1)).alias("cases"), F.count_if("evasive").alias("evasive"), F.count_if("right_volume").alias("right_volume"), *kinds, F.count("facts").alias("judged"), F.round(F.avg("facts"), 2).alias("facts"), F.round(F.avg("invention"), 2).alias("invention"))
    return made.withColumn(project, F.coalesce(project, F.lit("all"))).withColumnRenamed(project, "project")


def report(made: DataFrame) -> DataFrame:
    """A campaign's report as numbered lines of text, the total first."""
    total = F.when(F.col("project") == "all", 0).otherwise(1)
    said = F.concat(F.rpad("project", 16, " "), F.lit(" cases "), "cases", F.lit("  evasive "), "evasive", F.lit("  right volume "), "right_volume", F.lit("  coverage "), "covered", F.lit("/"), "partial", F.lit("/"), "uncovered", F.lit("  facts "), F.coalesce(F.col("facts").cast("string"), F.lit("-")), F.lit("  invention "), F.coalesce(F.col("invention").cast("string"), F.lit("-")))
    lines = made.agg(F.array_sort(F.collect_list(F.struct(total.alias("o"), F.col("project"), said.alias("line")))).alias("l"))  # a line for each project
    return lines.select(F.posexplode(F.transform("l", lambda x: x["line"])).alias("nth", "line"))


def read_first(facts: Column, invention: Column) -> Column:
    """Is a case to be read first: without marks, or with a low one?"""
    return facts.isNull() | F.coalesce((facts <= LOW_MARK) | (invention <= LOW_MARK), F.lit(False))


def compared(a: DataFrame, b: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``cases`` that both runs have, and of each column in how many both say the same, nulls too."""
    other = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in names])
    return a.join(other, key).agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"same_{c}") for c in names])


def averages(rows: DataFrame, names: list[str], digits: int = 3) -> DataFrame:
    """Means over all rows, nulls and NaN apart, and their number."""
    return rows.agg(*[F.round(F.avg(F.nanvl(c, F.lit(None))), digits).alias(c) for c in names], F.count(F.lit(1)).alias("n"))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, p50, p95`` from sketches whose size doesn't grow with the rows."""
    p = lambda q: F.percentile_approx(value, F.lit(q), F.lit(ACCURACY))
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(p(0.5), 6).alias("p50"), F.round(p(0.95), 6).alias("p95"))


#: Of each metric the mean that is wanted, and the one below which it is grave.
GOALS = {"faithfulness": (0.80, 0.6), "relevancy": (0.75, 0.5), "recall": (0.70, 0.4)}


def mean(score: str | Column) -> Column:
    """The mean of scores, to nine decimals: a mean at its goal is not below it because of the order in which doubles were added."""
    return F.round(F.avg(score), 9)


def severity(metric: str, mean: Column) -> Column:
    goal, grave = GOALS[metric]
    return F.when(mean < grave, "high").when(mean < goal, "medium").otherwise("none")


def suggestions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, param, current, suggested`` for every metric of a row below its goal.

    ``rows``: the mean of each metric of ``GOALS`` (a null one suggests nothing) and the current
    settings ``temperature, rerank_top_n, max_tokens, bm25_top_k, dense_top_k, fusion_top_k,
    chunk_size, chunk_overlap, bm25_weight``.
    """
    c, lit = F.col, F.lit
    size = F.when(c("chunk_size") > 500, F.greatest(c("chunk_size") - 200, lit(300))).otherwise(c("chunk_size"))
    weight = F.least(c("bm25_weight") + 0.05, lit(0.60))
    more = lambda name, n, most: (name, c(name), F.least(c(name) + n, lit(most)))
    changes = {
        "faithfulness": [("temperature", c("temperature"), F.when(c("temperature") > 0.05, F.greatest(lit(0.0), c("temperature") - 0.05)).otherwise(lit(0.0))), more("rerank_top_n", 5, 25)],
        "relevancy": [("max_tokens", c("max_tokens"), F.greatest(c("max_tokens"), lit(4096)))],
        "recall": [
            more("bm25_top_k", 20, 80), more("dense_top_k", 20, 80), more("fusion_top_k", 10, 50), ("chunk_size", c("chunk_size"), size),
            ("chunk_overlap", c("chunk_overlap"), F.greatest(F.floor(size * 0.15), lit(50))), ("bm25_weight", c("bm25_weight"), weight), ("dense_weight", 1 - c("bm25_weight"), F.round(1 - weight, 2)),
        ],
    }
    number = lambda x: F.round(x.cast("double"), 4)
    lists = [F.when(c(m) < GOALS[m][0], F.array(*[F.struct(lit(m).alias("metric"), lit(p).alias("param"), number(now).alias("current"), number(then).alias("suggested")) for p, now, then in found])) for m, found in changes.items()]
    none = F.array().cast("array<struct<metric:string,param:string,current:double,suggested:double>>")
    return rows.select(*keys, F.explode(F.concat(*[F.coalesce(x, none) for x in lists])).alias("s")).select(*keys, "s.*")
