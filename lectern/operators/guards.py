"""Deterministic guards on answers: evasion, repetition, unsupported numbers and pages, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns on text without accents. They tell statements of absence and citations.
ABSENCE = r"(?i)n(?:e |')(?:contien|mentionn|fourni|permet|cite|precise|indique|detaille|comporte|evoque|abord)\w* (?:pas|aucun)|aucune? (?:information|mention|precision|element)|pas d(?:e |')(?:information|mention|precision)|reste(?:nt)? muet|(?:est|sont) absente?s? d"
STANCE_ABSENCE = (
    r"(?i)n(?:e |')(?:contien(?:t|nent)|mentionn(?:e|ent)|fourni(?:t|ssent)|permet(?:tent)?|cite(?:nt)?|precise(?:nt)?|indique(?:nt)?|detaille(?:nt)?|comporte(?:nt)?|evoque(?:nt)?|abord(?:e|ent)) (?:pas|aucun)"
    r"|n'en parle(?:nt)? pas|(?:n'est|ne sont) pas (?:explicitement )?(?:mentionn|precis|indiqu|detaill|abord)"
    r"|aucune information|aucune mention|aucune precision|aucun element|pas d'information|pas de mention|pas de precision|reste(?:nt)? muet|est absente? d|sont absentes? d"
)
CITATION = r"(?i)\bp(?:age)?s?\.?\s*\d+|source\s*:|\.pdf"
CITED_SOURCE = r"(?i)\.pdf|tome[_ ]?\d|\[?source\s*:|volet\s+(?:environnement|milieu|paysage)|\bRNT\b|p\.\s*\d+"
CITATION_ZONE = r"(?i)\[Source:[^\]]*\]|\((?:Source|Tome)[^)]*\)|\b(?:pages?|p\.)\s*\d+(?:\s*(?:-|–|à)\s*\d+)?"
LIST_NUMBER = r"(?m)^\s*\d+[.)]\s"
LIST_MARK = r"^\s*(?:\d+[.)]|[-*•])\s*"


def evasive(answer: Column) -> Column:
    """An answer that states absence early, or at all while short or without a citation. No answer is evasive."""
    plain = T.deaccent(answer)
    at = F.regexp_instr(plain, F.lit(ABSENCE))
    said = at > 0
    weak = ((at - 1) < 0.15 * F.length(plain)) | (F.length(plain) < 700) | ~plain.rlike(CITATION)
    return F.when(F.coalesce(answer, F.lit("")) == "", True).otherwise(said & weak)


def stance(answer: Column, absence: str = STANCE_ABSENCE) -> Column:
    """``ESQUIVE``, ``concede`` or ``repond``."""
    plain = T.deaccent(answer)
    at = F.regexp_instr(plain, F.lit(absence))
    weak = ((at - 1) / F.length(plain) < 0.15) | (F.length(plain) < 700) | ~plain.rlike(CITED_SOURCE)
    return F.when(F.coalesce(answer, F.lit("")) == "", "ESQUIVE").when(at == 0, "repond").when(weak, "ESQUIVE").otherwise("concede")


def degenerate(answers: DataFrame, key: str, text: str, least: int = 8, ratio: float = 0.6, repeats: int = 4) -> DataFrame:
    """``key, degenerate``: eight long lines or more of which under 60 % differ or one comes four times. Numbering, case and marks don't count.

    Lines are counted as rows of their answer, each cleaned once; answers without long lines,
    null ones too, are not degenerate. Rows of one key are judged together.
    """
    line = lambda x: F.lower(F.trim(F.regexp_replace(T.deaccent(F.regexp_replace(x, LIST_MARK, "")), r"(?U)\W+", " ")))
    lines = answers.select(key, F.explode_outer(F.split(text, "\n")).alias("_raw")).select(key, line(F.col("_raw")).alias("_line"))
    long_ = F.col("_line").isNotNull() & (F.length("_line") > 20)
    counts = lines.select(key, F.when(long_, F.col("_line")).alias("_line")).groupBy(key, "_line").agg(F.count("_line").alias("_n"))
    found = counts.groupBy(key).agg(F.sum("_n").alias("n"), F.count("_line").alias("distinct"), F.max("_n").alias("most"))
    return found.select(key, ((F.col("n") >= least) & ((F.col("distinct") < ratio * F.col("n")) | (F.col("most") >= repeats))).alias("degenerate"))


def unsupported_numbers(answer: Column, passages: Column, least_digits: int = 2) -> Column:
    """Numbers of the answer as written, citations and list numbers aside, that no passage holds in any spelling."""
    bare = F.regexp_replace(F.regexp_replace(answer, CITATION_ZONE, " "), LIST_NUMBER, " ")
    there = T.numbers(passages)
    big = lambda x: x["said"].contains(".") | (F.length(x["whole"]) >= least_digits)
    held = lambda x: F.array_contains(there, x["said"]) | F.array_contains(there, x["whole"]) | F.array_contains(there, F.replace(x["said"], F.lit("."), F.lit("")))
    out = F.transform(F.filter(T.numbers_as_written(bare), lambda x: big(x) & ~held(x)), lambda x: x["written"])
    return F.when((answer == "") | (passages == ""), F.array().cast("array<string>")).otherwise(out)


#: How a file or a volume is named before a page, and how far before it.
CITED_FILE = r"([\w\-()]+(?:[ .][\w\-()]+)*\.pdf)"
CITED_VOLUME = r"\btome\s*(\d+)"
NEAR = 300


def cited_with_context(answers: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each page citation: ``key, first, last, before``, the text up to ``NEAR`` characters before it in small letters. A range that runs back or over more than 20 pages counts as its first page."""
    found = answers.select(key, text, F.explode(F.sequence(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(T.CITED_PAGES), F.lit(0))))).alias("_n")).where("_n > 0")
    rest = F.split(text, T.CITED_PAGES)
    cited = F.regexp_extract_all(text, F.lit(T.CITED_PAGES), F.lit(0))
    before = F.concat(F.get(rest, F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda k: F.concat(F.get(cited, k - 1), F.get(rest, k))), ""))
    before = F.when(F.col("_n") == 1, F.get(rest, F.lit(0))).otherwise(before)
    said = F.get(cited, F.col("_n") - 1)
    first = F.regexp_extract(said, T.CITED_PAGES, 1).cast("int")
    last = F.coalesce(F.nullif(F.regexp_extract(said, T.CITED_PAGES, 2), F.lit("")).cast("int"), first)
    out = found.select(key, F.col("_n").alias("nth"), first.alias("first"), last.alias("last"), F.lower(F.right(before, F.lit(NEAR))).alias("before"))
    return out.withColumn("last", F.when((F.col("last") < F.col("first")) | (F.col("last") - F.col("first") > 20), F.col("first")).otherwise(F.col("last")))


def pages_outside_files(answers: DataFrame, lots: DataFrame, key: str, text: str) -> DataFrame:
    """``key, outside``: cited pages that the lot lacks, as ``file p. n`` or ``p. n``, each once, in order.

    ``lots``: ``key, file_name, page``. A citation belongs to the file that is named last before
    it, in full or by its end, or to the volume if one file has its number; the nearer name
    counts. Without one of the lot it may be on any page of the lot. A range is in if both its
    ends are. Answers without a lot have nothing outside.
    """
    files = lots.select(key, F.lower("file_name").alias("file"), "page").distinct()
    pages = files.groupBy(key).agg(F.collect_set("page").alias("all"), F.array_sort(F.collect_set("file")).alias("files"))  # of one lot
    by_file = files.groupBy(key, "file").agg(F.collect_set("page").alias("own"))
    cited = cited_with_context(answers, key, text).join(pages, key)
    named = lambda pattern: F.element_at(F.regexp_extract_all("before", F.lit(pattern), F.lit(1)), -1)
    spot = lambda pattern: F.coalesce(F.length(F.regexp_extract("before", rf"(?s)^.*(?:{pattern})", 0)), F.lit(0))
    cited = cited.withColumns({"_file": F.trim(F.try_element_at(F.regexp_extract_all("before", F.lit(CITED_FILE), F.lit(1)), F.lit(-1))), "_volume": F.try_element_at(F.regexp_extract_all("before", F.lit(CITED_VOLUME), F.lit(1)), F.lit(-1)), "_at_file": spot(CITED_FILE), "_at_volume": spot(CITED_VOLUME)})
    # The name's words may begin with words of the sentence: the longest end of it that a file ends with counts.
    words = F.split("_file", " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, k, F.size(words)), " "))
    fits = F.filter(ends, lambda e: F.exists("files", lambda f: f.endswith(e)))
    shortest = F.get(F.transform(F.array_sort(F.transform(F.filter("files", lambda f: f.endswith(F.get(fits, F.lit(0)))), lambda f: F.struct(F.length(f).alias("n"), f.alias("f")))), lambda x: x["f"]), F.lit(0))
    own_file = F.when(F.col("_file").isNotNull(), F.coalesce(F.when(F.size(fits) > 0, shortest), F.element_at(words, -1)))
    volumes = F.filter("files", lambda f: F.contains(f, F.concat(F.lit("tome_"), F.col("_volume"))) | F.contains(f, F.concat(F.lit("tome "), F.col("_volume"))))
    by_volume = F.col("_volume").isNotNull() & (F.col("_at_volume") > F.col("_at_file")) & (F.size(volumes) == 1)
    cited = cited.withColumn("file", F.when(by_volume, F.get(volumes, F.lit(0))).otherwise(own_file))
    there = F.coalesce("own", "all")
    judged = cited.join(by_file, [key, "file"], "left").withColumn("_there", there)
    whole = (F.col("last") != F.col("first")) & F.array_contains("_there", F.col("first")) & F.array_contains("_there", F.col("last"))
    missing = F.when(whole, F.array().cast("array<int>")).otherwise(F.filter(F.sequence("first", "last"), lambda p: ~F.array_contains("_there", p)))
    label_ = F.concat(F.coalesce(F.concat("file", F.lit(" ")), F.lit("")), F.lit("p. "))
    parts = judged.select(key, "nth", F.transform(missing, lambda p: F.concat(label_, p)).alias("labels"))
    found = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "labels"))).alias("parts"))  # of one answer
    said = F.array_distinct(F.flatten(F.transform("parts", lambda x: x["labels"])))
    return answers.select(key).join(found, key, "left").select(key, F.coalesce(said, F.array().cast("array<string>")).alias("outside"))


def _stated(text: Column, least_digits: int = 2) -> Column:
    """``numbers, names`` of an answer, whatever the lot: numbers in one spelling, and words that may be proper nouns."""
    zone = F.regexp_replace(text, CITATION_ZONE, " ")
    big = lambda x: x["said"].contains(".") | (F.length(x["whole"]) >= least_digits)
    numbers = F.transform(F.filter(T.numbers_as_written(F.regexp_replace(zone, LIST_NUMBER, " ")), big), lambda x: x["said"])
    return F.struct(F.array_distinct(numbers).alias("numbers"), T.capitalised(zone).alias("names"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def concrete(text: Column, lot: Column, least_digits: int = 2) -> Column:
    """What an answer holds of the lot's data: numbers in one spelling and proper nouns, sorted."""
    return _let(_stated(text, least_digits), lambda s: _held(s, lot, T.numbers(lot)))


def _held(stated: Column, lot: Column, there: Column) -> Column:
    return F.array_sort(F.array_union(F.array_intersect(stated["numbers"], there), T.named_in(stated["names"], lot)))


def retention(synthesis: Column, blocks: Column, lot: Column, most_lines: int = 25, there: Column | None = None) -> Column:
    """How much of the blocks' data a synthesis keeps: ``rate, missing, lines`` (lines of the blocks that carry what is missing, at most ``most_lines``).

    ``there``: the lot's numbers, where many rows have one lot. The lot is asked about what the
    blocks state only: what is missing is in it, so a line or the synthesis has it if it states it.
    """
    all_ = lambda s: F.concat(s["numbers"], s["names"])
    there = T.numbers(lot) if there is None else there
    bare = F.regexp_replace(synthesis, CITATION_ZONE, " ")
    first = F.struct(_let(_stated(blocks), lambda s: _held(s, lot, there)).alias("wanted"), all_(_stated(synthesis)).alias("own"), bare.alias("bare"))

    def lost(x: Column) -> Column:
        kept = lambda v: F.array_contains(x["own"], v) | (v.rlike("^[0-9]") & (F.contains(x["bare"], v) | F.contains(x["bare"], F.replace(v, F.lit("."), F.lit(",")))))
        return F.struct(F.size(x["wanted"]).alias("n"), F.filter(x["wanted"], lambda v: ~kept(v)).alias("missing"))

    def told(x: Column) -> Column:
        rate = F.when(x["n"] == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.size(x["missing"]), x["n"]))
        carries = lambda line: line.rlike(r"\S") & ~line.rlike(r"^\s*#{1,6}\s") & F.arrays_overlap(all_(_stated(line)), x["missing"])
        lines = F.when(F.size(x["missing"]) > 0, F.filter(F.split(blocks, "\n"), carries)).otherwise(F.array().cast("array<string>"))
        clean = F.array_distinct(F.transform(lines, lambda l: F.trim(F.replace(F.regexp_replace(l, LIST_MARK, ""), F.lit("**"), F.lit("")))))  # noqa: E741
        return F.struct(F.round(rate, 4).alias("rate"), x["missing"].alias("missing"), F.slice(F.filter(clean, lambda l: l != ""), F.lit(1), F.lit(most_lines)).alias("lines"))  # noqa: E741

    return _let(_let(first, lost), told)


def completed(synthesis: Column, kept: Column, threshold: float = 0.6) -> Column:
    """A synthesis that keeps too little gets the lines it lacks put behind it. ``kept``: :func:`retention`."""
    return F.when((kept["rate"] < threshold) & (F.size(kept["lines"]) > 0), F.concat(synthesis, F.lit("\n\n- "), F.array_join(kept["lines"], "\n- "))).otherwise(synthesis)


def block_flags(answer: Column, passages: Column, truncated_: Column, degenerate_: Column) -> Column:
    """What is wrong with an answer block and what to do: ``evasive, retry`` (``deep``, ``again`` or ``none``), ``numbers``."""
    denies = evasive(answer)
    retry = F.when(denies, F.lit("deep")).when(truncated_ | degenerate_, F.lit("again")).otherwise(F.lit("none"))
    return F.struct(denies.alias("evasive"), retry.alias("retry"), unsupported_numbers(answer, passages).alias("numbers"))


def routed(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, test in rules:
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def unsupported_pages(answer: Column, pages: Column) -> Column:
    """Cited pages outside the lot's pages, where no file is named."""
    return F.array_except(T.cited_pages(answer), pages)


def confidence(verdict: Column, guards: Column) -> Column:
    base = F.when(verdict == "COUVERT", 0.8).when(verdict == "PARTIEL", 0.5).otherwise(0.2)
    return F.round(F.greatest(F.lit(0.1), base - 0.1 * guards), 2)


def public_verdict(verdict: Column) -> Column:
    return F.when(verdict == "COUVERT", "SUFFISANT").when(verdict == "NON_COUVERT", "INSUFFISANT").otherwise("PARTIEL")


def label(name: Column, first: Column, last: Column) -> Column:
    """``[Source: name, page a]`` or ``pages a à b``."""
    page = F.when(first.isNull(), F.lit("")).when(last.isNull() | (last == first), F.concat(F.lit(", page "), first)).otherwise(F.concat(F.lit(", pages "), first, F.lit(" à "), last))
    return F.concat(F.lit("[Source: "), name, page, F.lit("]"))


def truncated(reason: Column, generated: Column, most: int) -> Column:
    return (reason == "length") | (generated >= most)


def judge_mark(said: Column, name: str) -> Column:
    """A mark from 0 to 2 out of a judge's JSON; anything else is 0."""
    found = F.get_json_object(F.regexp_extract(said, r"(?s)\{.*\}", 0), f"$.{name}").try_cast("int")
    return F.coalesce(F.least(F.lit(2), F.greatest(F.lit(0), found)), F.lit(0))
