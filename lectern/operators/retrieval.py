"""Retrieval over many questions at once: lexical and dense scoring, fusion, selection."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .near_terms import near
from .shared import new_folder, settled, text_slices
from .term_index import TermIndex, terms_asked


def facet_filter(df: DataFrame, facets: dict[str, object]) -> DataFrame:
    """Scalar facets are equalities, lists are memberships, empty ones are skipped; all must hold. Apply it before any top-k."""
    for name, value in facets.items():
        if isinstance(value, list | tuple | set):
            if value:
                df = df.where(F.col(name).isin(*value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def terms(text: Column) -> Column:
    """Words of letters and digits of any script, in small letters without accents."""
    return F.array_remove(F.split(T.deaccent(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), "")


#: French articles and pronouns before an apostrophe, and words too frequent to search for (without accents).
ELISIONS = "l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split()
FRENCH_STOP_WORDS = (
    "a ai aient ainsi apres as au aucun aucune aujourd aussi autre autres aux avaient avait avant avec avez avoir avons ayant bien car ce ceci cela celle celles celui cependant ces cet cette ceux chaque ci comme comment "
    "d dans de depuis des deux doit donc dont du elle elles en encore entre es est et etaient etait etant ete etes etre eu eux fait faites fois font hors ici il ils je juste l la laquelle le lequel les lesquels leur leurs lui "
    "ma mais me meme memes mes moi moins mon ne ni nos notre nous on ont ou par parce pas peu peut plus pour pourquoi quand que quel quelle quelles quels qui sa sans se sera ses si sien son sont sous soyez sur ta tandis tellement "
    "tels tes toi ton tous tout toute toutes tres tu un une va vers voici voila vont vos votre vous vu y"
).split()


#: Endings of the light French stemmer, each with the length that a word must exceed and what takes its place. Of the first list the first that fits is the last step, else of the second, else of the third.
FIRST_ENDINGS = ((9, "issement", "ir"), (8, "issant", "ir"), (7, "ivement", "if"), (6, "ement", "e"), (11, "ficatrice", "fier"), (10, "ficateur", "fier"), (9, "catrice", "quer"), (8, "cateur", "quer"), (8, "atrice", "er"), (7, "ateur", "er"))
SECOND_ENDINGS = ((5, "ième", ""), (7, "teuse", "ter"), (6, "teur", "ter"), (5, "euse", "eu"), (8, "ère", "er"), (7, "ive", "if"), (4, "folle", "fou"), (4, "molle", "mou"), (9, "nnelle", "n"), (9, "nnel", "n"))
THIRD_ENDINGS = ((8, "esse", "e"), (7, "inage", "in"), (12, "ualisation", "uel"), (9, "isation", ""), (9, "isateur", ""), (8, "ation", ""), (8, "ition", ""))
#: Endings that are changed before the second list, and before the third, after which the cascade goes on.
BEFORE_SECOND, BEFORE_THIRD = ((6, "trice", "teur"),), ((4, "ète", "et"), (8, "ique", ""))
FRENCH_ACCENTS = ("àáâôèéêùûîç", "aaaoeeeuuic")


def stem(w: str) -> str:
    """Light French stem of a word in small letters: plurals, then the longest chain of feminines, verb and adjective endings that the lists allow, accents, doubled letters and last vowels."""
    if len(w) > 5 and w.endswith("aux") and w[-4] != "e":
        w = f"{w[:-2]}l"
    elif len(w) > 5 and w.endswith("x"):
        w = w[:-1]
    for c in "xs":
        w = w[:-1] if len(w) > 3 and w.endswith(c) else w
    for first, before in ((FIRST_ENDINGS, BEFORE_SECOND), (SECOND_ENDINGS, BEFORE_THIRD), (THIRD_ENDINGS, ())):
        if rule := next((x for x in first if len(w) > x[0] and w.endswith(x[1])), None):
            w = w[: -len(rule[1])] + rule[2]
            break
        for least, old, new in before:
            w = w[: -len(old)] + new if len(w) > least and w.endswith(old) else w
    if len(w) > 4:
        w = re.sub(r"(.)\1+", lambda m: m[1] if m[1].isalpha() else m[0], w.translate(str.maketrans(*FRENCH_ACCENTS)), flags=re.DOTALL)
    w = w[:-2] if len(w) > 4 and w.endswith("ie") else w
    if len(w) > 4:
        w = re.sub(r"e?e?r?\Z", "", w, count=1)
        w = w[:-1] if len(w) > 1 and w[-1] == w[-2] and w[-1].isalpha() else w
    return w


#: Words whose stems a worker remembers at once.
MOST_WORDS = 1 << 18


def _by_word(made: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A function of words as one of arrays of words; words that give nothing are left out. It is called once for each distinct word of a batch at most."""
    known: dict[str, str | None] = {}

    @F.arrow_udf("array<string>")
    def of(lists: pa.Array) -> pa.Array:
        if len(known) > MOST_WORDS:
            known.clear()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        for w in words:
            if w not in known:
                known[w] = made(w)
        out = pa.array([known[w] for w in words], pa.string()).take(coded.indices)
        stay = out.is_valid().to_numpy(zero_copy_only=False)
        ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        left = np.concatenate([[0], stay.cumsum()])[np.concatenate([[0], ends])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(left), out.drop_null())

    return of


def stemmed(words: Column) -> Column:
    """Light French stems of words in small letters, in their order."""
    return _by_word(stem)(words)


def french_terms(text: Column) -> Column:
    """French words for searching: elided articles and frequent words left out, stems of the others, without accents."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\u2019\u2018", "''")
    bare = F.regexp_replace(low, rf"(^|[^\p{{L}}\p{{N}}\p{{Mn}}])({'|'.join(ELISIONS)})'", "$1")
    words = F.array_remove(F.split(bare, r"[^\p{L}\p{N}\p{Mn}]+"), "")
    stop = frozenset(FRENCH_STOP_WORDS)
    return _by_word(lambda w: None if T.plain(w) in stop else T.plain(stem(w)) or None)(words)


def path_terms(path: Column) -> Column:
    """A path and the paths above it."""
    return T.path_prefixes(F.coalesce(path, F.lit("")))


def bm25(docs: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text", qid: str = "item_id", question: str = "text", k1: float = 1.2, b: float = 0.75, k: int | None = None, index: TermIndex | None = None) -> DataFrame:
    """``qid, key, score`` for every document that shares a term with a question, or for each question's best ``k`` of every shard, which :func:`top` merges. Statistics cover all documents. ``index`` has the terms of ``text``; without one it is made."""
    index = index or TermIndex.build(docs, {"text": terms(F.col(text))}, key, new_folder(docs.sparkSession, "term-index"))
    return index.scores(terms_asked(questions, qid, {"text": terms(F.col(question))}), qid, key, k, k1, b).select(qid, key, "score")


@dataclass(frozen=True)
class Field:
    """A searched field: what its terms are and how much its score counts."""

    column: str
    boost: float
    analysis: Callable[[Column], Column] = french_terms


#: The fields of an index and their boosts.
FIELDS = (Field("text", 3.0), Field("text_with_context", 2.0), Field("file_name", 2.0, terms), Field("file_path", 1.5, path_terms), Field("title", 2.0), Field("author", 1.0, terms))


def expanded(asked: DataFrame, vocabulary: DataFrame, most: int = 10) -> DataFrame:
    """``asked`` (``field, term`` and more) with ``found``, ``distance`` and ``share``: at most ``most`` terms of the field's vocabulary with the same first two letters at an edit distance that the term's length allows (a swap of neighbours is one edit), itself among them. Terms further off count for less."""
    near_ = near(asked, vocabulary)
    w = Window.partitionBy("field", "term").orderBy("distance", "found")  # terms at so small a distance
    best = near_.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    share = 1 - F.col("distance") / F.least(F.length("term"), F.length("found"))
    return asked.join(best.select("field", "term", "found", "distance", share.alias("share")), ["field", "term"])


def search_index(docs: DataFrame, folder: str, fields: tuple[Field, ...] = FIELDS, key: str = "doc_id") -> TermIndex:
    return TermIndex.build(docs, {f.column: f.analysis(F.col(f.column)) for f in fields}, key, folder)


def search(docs: DataFrame, questions: DataFrame, fields: tuple[Field, ...] = FIELDS, key: str = "doc_id", qid: str = "item_id", question: str = "text", fuzzy: bool = False, k: int | None = None, index: TermIndex | None = None) -> DataFrame:
    """``qid, key, score`` of the best field: each field's sum over the question's terms, with its own statistics, times its boost. ``fuzzy`` adds near terms of each field's vocabulary. With ``k`` only documents that are among the best ``k`` of a field in a shard, so all that :func:`top` can want."""
    index = index or search_index(docs, new_folder(docs.sparkSession, "term-index"), fields, key)
    asked = terms_asked(questions, qid, {f.column: f.analysis(F.col(question)) for f in fields})
    if fuzzy:
        vocabulary = index.rows.where("term <> ''").select("field", "term").distinct()
        near_ = expanded(asked.drop("share"), vocabulary)
        asked = settled(near_.select(qid, "field", F.col("found").alias("term"), "share"), "near-terms")
    if k is None:
        return index.best_fields(asked, qid, key, {f.column: f.boost for f in fields})
    boost = F.create_map(*[x for f in fields for x in (F.lit(f.column), F.lit(f.boost))])
    return index.scores(asked, qid, key, k).groupBy(qid, key).agg(F.max(boost[F.col("field")] * F.col("score")).alias("score"))


#: Vectors and questions of one block.
VECTOR_BLOCK, QUESTION_BLOCK = 4096, 512


def _packed(rows: DataFrame, id_: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of unit vectors: ids and, row by row, the coordinates as doubles. Vectors without length stay zero."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                x = np.array(part.column(1).to_pylist(), np.float64)
                norm = np.sqrt((x * x).sum(1, keepdims=True))
                x = x / np.where(norm > 0, norm, 1)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], list(names))

    return rows.select(id_, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull()).mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary")


def dense(vectors: DataFrame, questions: DataFrame, k: int, key: str = "vec_id", qid: str = "qid", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``qid, key, score``: of every pair of a block of vectors and a block of questions the ``k`` nearest of each question, by rounded cosine, then by key. :func:`top` merges them.

    Blocks have a fixed size; Spark sends the questions' blocks to all only if they are small.
    A vector without length has cosine 0 with any other; null vectors are in no list. Keys are
    integers.
    """
    pairs = _packed(vectors, key, vector, VECTOR_BLOCK, ("keys", "points")).crossJoin(_packed(questions, qid, vector, QUESTION_BLOCK, ("qids", "aims")))
    return compared(pairs, k, key, qid, digits)


def compared(pairs: DataFrame, k: int, key: str, qid: str, digits: int = 6) -> DataFrame:
    """``qid, key, score``: of every pair of a block of vectors (``keys, points``) and one of questions (``qids, aims``) each question's ``k`` nearest, by rounded cosine, then by key."""
    key_kind, qid_kind = (pairs.schema[c].dataType.elementType.simpleString() for c in ("keys", "qids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, qids = (np.asarray(batch.column(c)[row].values) for c in (0, 2))
                points, aims = (np.frombuffer(batch.column(c)[row].as_py(), np.float64).reshape(len(ids), -1) for c, ids in ((1, keys), (3, qids)))
                score = np.rint(aims @ points.T * 10**digits).astype(np.int64)
                most = min(k, len(keys))
                # Distinct whole numbers: the score, then the key's place from the end.
                place = np.empty(len(keys), np.int64)
                place[np.argsort(keys, kind="stable")] = np.arange(len(keys))[::-1]
                at = np.argpartition(-(score * len(keys) + place), most - 1, axis=1)[:, :most]
                best = np.take_along_axis(score, at, 1) / 10**digits
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, most)), pa.array(keys[at.ravel()]), pa.array(best.ravel())], [qid, key, "score"])

    return pairs.mapInArrow(run, f"{qid} {qid_kind}, {key} {key_kind}, score double")


#: Trigrams whose places a task remembers at once.
MOST_GRAMS = 1 << 18


def hashed_vectors(docs: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """A stand-in for an encoder: trigrams of letters hashed into ``dimensions`` signed buckets, at unit length; a vector for each row. A text without trigrams has the zero vector."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs: dict[int, tuple[int, float]] = {}

        def sign(gram: int) -> tuple[int, float]:
            if gram not in signs:
                h = zlib.crc32("".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0)).encode())
                signs[gram] = h % dimensions, 1.0 if h // dimensions % 2 == 0 else -1.0
            return signs[gram]

        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                c = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
                ends = np.cumsum([len(x) for x in texts])
                row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: max(len(c) - 2, 0)]
                inside = ends[row] - np.arange(len(row)) >= 3
                grams, which = np.unique(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], return_inverse=True)
                if len(signs) > MOST_GRAMS:
                    signs.clear()
                bucket, value = (np.array(x) for x in zip(*map(sign, grams.tolist()), strict=True)) if len(grams) else (np.zeros(0, int), np.zeros(0))
                sums = np.bincount(row[inside] * dimensions + bucket[which], value[which], len(texts) * dimensions).reshape(-1, dimensions)
                norm = np.sqrt((sums * sums).sum(1, keepdims=True))
                unit = sums / np.where(norm > 0, norm, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dimensions, dtype=np.int32), pa.array(unit.ravel()))], [key, "embedding"])

    return docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


@dataclass(frozen=True)
class Profile:
    """How many rows each step of a search takes. ``with_`` gives a profile with other numbers in place of its own."""

    lexical: int = 40
    dense: int = 40
    search: int = 100
    fusion: int = 30
    rerank: int = 15

    def with_(self, **numbers: int) -> Profile:
        return replace(self, **numbers)


#: The pools of a deep search.
DEEP = Profile(lexical=80, dense=80, search=200, fusion=60, rerank=20)


def funnel(fused: DataFrame, scores: DataFrame, qid: str, key: str, profile: Profile, keep: Column | None = None) -> DataFrame:
    """From a fused list to the answer's passages: the first ``fusion`` of ``search``, reranked by ``scores`` (``qid, key, score``; equal ones in the order they came), those that ``keep`` holds for, the first ``rerank``. ``place`` numbers them."""
    rows = fused.where(F.col("rank") <= min(profile.search, profile.fusion)).join(scores, [qid, key], "left")
    w = Window.partitionBy(qid).orderBy(F.desc_nulls_last("score"), "rank")  # ``fusion`` rows of a question
    ranked = rows.withColumn("_at", F.row_number().over(w))
    ranked = ranked if keep is None else ranked.where(keep)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(qid).orderBy("_at"))).where(F.col("place") <= profile.rerank).drop("_at")


def overlap(question: Column, text: Column, digits: int = 6) -> Column:
    """A stand-in for a reranking model: the share of the question's distinct terms that the text has."""
    asked = F.array_distinct(terms(question))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms(text))), F.size(asked)), F.lit(0.0)), digits)


def top(scored: DataFrame, qid: str, key: str, k: int, digits: int = 6) -> DataFrame:
    """Best ``k`` rows for each question with ``rank``; ties by key. Scores are rounded first so that ranks are stable."""
    w = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(lexical: DataFrame, dense_: DataFrame, qid: str, key: str, k: int = 60, w_lexical: float = 0.45, w_dense: float = 0.55) -> DataFrame:
    """Weighted reciprocal ranks. Ties keep lexical order, then that of rows only the dense list has."""
    a = lexical.select(qid, key, F.col("rank").alias("lexical_rank"))
    b = dense_.select(qid, key, F.col("rank").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    both = a.join(b, [qid, key], "full_outer").withColumn("rrf", F.round(part(w_lexical, "lexical_rank") + part(w_dense, "dense_rank"), 9))
    w = Window.partitionBy(qid).orderBy(F.desc("rrf"), F.coalesce("lexical_rank", F.col("dense_rank") + 1_000_000_000))
    return both.withColumn("rank", F.row_number().over(w))


def capped(ranked: DataFrame, qid: str, secondary: Column, excluded: Column, cap: int, top_n: int) -> DataFrame:
    """Walk each ranked list: leave out excluded rows, keep at most ``cap`` secondary ones, cut at ``top_n``."""
    rows = ranked.where(~excluded).withColumn("_second", secondary)
    w = Window.partitionBy(qid, "_second").orderBy("rank")
    rows = rows.withColumn("_nth", F.row_number().over(w))
    if cap > 0:
        rows = rows.where(~F.col("_second") | (F.col("_nth") <= cap))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(qid).orderBy("rank"))).where(F.col("place") <= top_n).drop("_second", "_nth")


def projected(hits: DataFrame, qid: str, order: str, most: int = 30, chars: int = 1000) -> DataFrame:
    """What is shown of a question's first ``most`` hits: ``file_name``, the first ``chars`` characters of ``text``, the score of the last step that gave one (rerank, fusion, search) and the page, a stated one before the first of a span; 0 is a page."""
    w = Window.partitionBy(qid).orderBy(order)
    rows = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return rows.select(qid, order, "file_name", F.substring("text", 1, chars).alias("text"), F.round(F.coalesce("rerank_score", "rrf_score", "score"), 4).alias("score"), F.coalesce("page", "page_start").alias("page"), F.coalesce("page", "page_end").alias("last_page"))


def distinct_sources(hits: DataFrame, qid: str, order: str, most: int = 10) -> DataFrame:
    """The first ``most`` distinct places of a question's hits, a path (or else a name) and its pages, each by its first hit."""
    place = [F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.col("file_name")), F.col("page_start"), F.col("page_end")]
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(qid, *place).orderBy(order))).where("_n = 1")
    rows = first.withColumn("_n", F.row_number().over(Window.partitionBy(qid).orderBy(order))).where(F.col("_n") <= most)
    return rows.drop("_n").withColumn("score", F.round("score", 4))
