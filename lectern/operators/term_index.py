"""An inverted index as a table, and exact scores of many questions from it.

Documents are dealt into shards by a hash of their keys. A row of the index is one term of one
field in one shard: the documents (numbered within the shard by their keys) and how often each
has it; the row of the term '' has the shard's keys and lengths. Scoring joins the asked terms
to their rows only, brings a shard's rows together with who asks for them, and adds up in numpy:
no row for a question and a document exists before the best ones are known.

For the best ``k`` of a question its terms are added from the one that can give most. Once what
the remaining terms can give together is less than the ``k``-th best sum so far, no document
without a sum can win any more, and of the others only those that can still reach it go on. A
first pass over one shard gives every question a sum that its ``k`` best have to reach in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settled

#: Documents of a shard, about; questions of a block; the decimals by which scores are told apart.
SHARD, BLOCK, DIGITS = 1 << 12, 1024, 6
#: Shards up to which no shard is scored before the others.
FEW = 32
_ROWS = "shard int, field string, term string, n long, total double, ids binary, counts binary"


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each is there; the parts are given up on the way."""
    every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    parts.clear()
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(first, append=len(every))


class TermIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.keys = spark.read.parquet(f"{folder}/keys")
        self.rows = spark.read.schema(_ROWS).parquet(f"{folder}/rows")

    @classmethod
    def build(cls, docs: DataFrame, fields: dict[str, Column], key: str, folder: str, shards: int | None = None) -> TermIndex:
        """Index ``docs``, each row a document; ``fields`` are arrays of terms. Rows without a key or a field without terms are not in it."""
        spark = docs.sparkSession
        docs = docs.where(F.col(key).isNotNull())
        if shards is None:
            shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD))
        shard = F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int").alias("shard")
        names = [*fields]
        dealt = docs.select(shard, F.col(key).alias("key"), *[c.alias(f"f{i}") for i, c in enumerate(fields.values())])

        def pack(table: pa.Table) -> pa.Table:
            n = table.num_rows
            place = np.empty(n, np.int64)  # of each row among the keys
            place[pc.sort_indices(table.column(1)).to_numpy()] = np.arange(n)
            out = []
            for i, name in enumerate(names):
                # Only a number for each word is kept beside the shard's rows: its term's and its document's in one.
                pairs, said, lengths = [], {}, np.zeros(n, np.int64)
                at = 0
                for lists in table.column(2 + i).chunks:
                    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    docs_ = place[at : at + len(lists)]
                    lengths[docs_] = sizes
                    at += len(lists)
                    coded = lists.flatten().dictionary_encode()
                    own = np.array([said.setdefault(w, len(said)) for w in coded.dictionary.to_pylist()], np.int64)
                    pairs.append(own[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(docs_, sizes) if len(own) else np.zeros(0, np.int64))
                pair, count = _counted(pairs)
                code, doc = pair // max(n, 1), (pair % max(n, 1)).astype("<i4")
                cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)] if len(code) else []
                count = count.astype("<i4")
                said, sizes = [*said], lengths
                out += [(name, said[code[a]], b - a, 0.0, doc[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                some = np.flatnonzero(sizes).astype("<i4")
                out.append((name, "", len(some), float(sizes.sum()), some.tobytes(), sizes[some].astype("<i4").tobytes()))
            number = table.column(0)[0].as_py() if table.num_rows else 0
            columns = [[number] * len(out), *zip(*out, strict=True)]
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _ROWS.split(", ")])

        dealt.select("shard", "key").groupBy("shard").agg(F.sort_array(F.collect_list("key")).alias("keys")).write.parquet(f"{folder}/keys")  # SHARD keys
        dealt.groupBy("shard").applyInArrow(pack, _ROWS).sortWithinPartitions("field", "term").write.parquet(f"{folder}/rows")
        return cls(spark, folder)

    def weighted(self, asked: DataFrame, qid: str, k1: float, b: float) -> DataFrame:
        """``qid, field, term, w, mean``: the asked terms with their idf times ``share``, and the field's mean length."""
        stats = self.rows.where("term = ''").groupBy("field").agg(F.sum("n").cast("double").alias("_docs"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
        df = self.rows.where("term <> ''").join(asked.select("field", "term").distinct(), ["field", "term"], "left_semi").groupBy("field", "term").agg(F.sum("n").cast("double").alias("_df"))
        idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        own = asked.groupBy(qid, "field", "term").agg(F.sum("share").alias("share"))
        return own.join(df, ["field", "term"]).join(stats, "field").select(F.col(qid).alias("qid"), "field", "term", (F.col("share") * idf).alias("w"), "mean")

    def scores(self, asked: DataFrame, qid: str, key: str, k: int | None = None, k1: float = 1.2, b: float = 0.75, first: bool | None = None) -> DataFrame:
        """``qid, field, key, score`` of asked ``qid, field, term, share``: of each shard and question the best ``k`` by rounded score, then key, or, without ``k``, every document with a term.

        ``first``: score one shard before the others, so that these know what sum to reach; by
        default where there are more than ``FEW`` shards.
        """
        asked = asked.where(f"term <> '' and `{qid}` is not null")
        kind = asked.schema[qid].dataType.simpleString()
        weighted = self.weighted(asked, qid, k1, b)
        reach = F.lit(0.0).alias("reach")
        if k is None or not (self.keys.count() > FEW if first is None else first):
            return self._scored(weighted.withColumn("reach", reach), kind, qid, key, k, k1, b, None)
        weighted = settled(weighted, "asked-terms")
        one = self.keys.agg(F.min("shard")).first()[0]
        if one is None:
            return self._scored(weighted.withColumn("reach", reach), kind, qid, key, k, k1, b, None)
        tried = settled(self._scored(weighted.withColumn("reach", reach), kind, qid, key, k, k1, b, F.col("shard") == one), "first-shard")
        known = tried.groupBy(qid, "field").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= k).select(F.col(qid).alias("qid"), "field", "_least")
        known = weighted.join(known, ["qid", "field"], "left").withColumn("reach", F.coalesce("_least", F.lit(0.0))).drop("_least")
        return tried.unionByName(self._scored(known, kind, qid, key, k, k1, b, F.col("shard") != one))

    def best_fields(self, asked: DataFrame, qid: str, key: str, boosts: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``qid, key, score`` of every document with an asked term: its best field's score times the field's boost.

        A shard's fields meet in one task, with its keys, so the only rows made are the results.
        """
        asked = asked.where(f"term <> '' and `{qid}` is not null")
        kind, key_kind = asked.schema[qid].dataType.simpleString(), self.keys.schema["keys"].dataType
        parts = self._parts(self.weighted(asked, qid, k1, b).withColumn("reach", F.lit(0.0)), self.rows)
        none = F.lit("").alias("field"), F.lit("").alias("term"), F.lit(b"").alias("ids"), F.lit(b"").alias("counts"), F.array().cast(parts.schema["who"].dataType).alias("who")
        named = self.keys.crossJoin(parts.select("block").distinct()).select("shard", "block", *none, "keys")
        return parts.withColumn("keys", F.lit(None).cast(key_kind)).unionByName(named).groupBy("shard", "block").applyInArrow(_best_field(boosts, k1, b, (qid, key)), f"`{qid}` {kind}, `{key}` {key_kind.elementType.simpleString()}, score double")

    def _parts(self, weighted: DataFrame, rows: DataFrame) -> DataFrame:
        """What a shard has for a block of questions: the asked terms' rows, each with who asks for it, and the lengths of each field."""
        block = F.pmod(F.xxhash64("qid"), F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK))).cast("int").alias("block")
        many = weighted.agg(F.approx_count_distinct("qid").alias("_n"))
        by = weighted.crossJoin(F.broadcast(many)).select(block, "field", "term", F.struct("qid", "w", "reach", "mean").alias("who"))  # one row
        by = by.groupBy("block", "field", "term").agg(F.collect_list("who").alias("who"))  # BLOCK questions, about
        found = rows.join(by, ["field", "term"]).select("shard", "block", "field", "term", "ids", "counts", "who")
        blocks = by.select("block", "field").distinct()
        lengths = rows.where("term = ''").join(blocks, "field").select("shard", "block", "field", "term", "ids", "counts", F.array().cast(found.schema["who"].dataType).alias("who"))
        return found.unionByName(lengths)

    def _scored(self, weighted: DataFrame, kind: str, qid: str, key: str, k: int | None, k1: float, b: float, where: Column | None) -> DataFrame:
        keys = self.keys if where is None else self.keys.where(where)
        parts = self._parts(weighted, self.rows if where is None else self.rows.where(where))
        scored = parts.groupBy("shard", "block", "field").applyInArrow(_scorer(k, k1, b), f"shard int, field string, qid {kind}, id int, score double")
        named = scored.join(keys, "shard")
        return named.select(F.col("qid").alias(qid), "field", F.get("keys", F.col("id")).alias(key), "score")


def _scorer(k: int | None, k1: float, b: float):
    """Scores of one shard's documents for one block of questions in one field."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out_q, out_id, out_s = [], [], []
        for qid, ids, sums in _sums(rows, k, k1, b):
            out_q += [qid] * len(ids)
            out_id.append(ids)
            out_s.append(sums)
        n = len(out_q)
        first = rows[0]
        shown = [pa.array(np.full(n, first["shard"], np.int32)), pa.array([first["field"]] * n, pa.string()), pa.array(out_q, table.schema.field("who").type.value_type.field("qid").type)]
        return pa.table([*shown, pa.array(np.concatenate(out_id) if n else np.zeros(0), pa.int32()), pa.array(np.concatenate(out_s) if n else np.zeros(0), pa.float64())], names=["shard", "field", "qid", "id", "score"])

    return run


def _sums(rows: list[dict], k: int | None, k1: float, b: float) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Each question's documents and their sums, from a shard's rows of one field."""
    of_all = next((r for r in rows if not r["term"]), None)
    if of_all is None or len(rows) == 1:
        return
    lengths = np.zeros(1 + int(np.frombuffer(of_all["ids"], "<i4").max(initial=0)))
    lengths[np.frombuffer(of_all["ids"], "<i4")] = np.frombuffer(of_all["counts"], "<i4")
    mean = next(r["who"][0]["mean"] for r in rows if r["who"])
    norm = k1 * (1 - b + b * lengths / mean)
    by_question: dict = {}
    for r in rows:
        if r["who"]:
            ids, tf = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4")
            part = tf / (tf + norm[ids])
            for who in r["who"]:
                by_question.setdefault(who["qid"], (who["reach"], []))[1].append((who["w"] * part.max(), r["term"], who["w"], ids, part))
    for qid, (reach, terms) in by_question.items():
        terms.sort(key=lambda t: (-t[0], t[1]))
        yield qid, *_best(terms, len(lengths), k, reach)


def _best_field(boosts: dict[str, float], k1: float, b: float, names: tuple[str, str]):
    """Of one shard's documents, for one block of questions, the best field's boosted score; rows of one key are one."""

    def run(table: pa.Table) -> pa.Table:
        keys = next(x for x in table.column("keys") if x.is_valid).values
        said = keys.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], said[1:] != said[:-1]]))
        by_field: dict = {}
        for r in table.drop_columns("keys").to_pylist():
            by_field.setdefault(r["field"], []).append(r)
        best: dict = {}
        for field, rows in by_field.items():
            for qid, ids, sums in _sums(rows, None, k1, b):
                own = best.setdefault(qid, np.zeros(len(said)))
                own[ids] = np.maximum(own[ids], boosts[field] * sums)
        merged = [np.maximum.reduceat(x, first) for x in best.values()]
        at = [np.flatnonzero(x) for x in merged]
        asked = pa.array([*best], table.schema.field("who").type.value_type.field("qid").type).take(np.repeat(np.arange(len(at), dtype=np.int32), [len(x) for x in at]))
        where = np.concatenate([first[x] for x in at]) if at else np.zeros(0, np.int64)
        score = np.concatenate([x[i] for x, i in zip(merged, at, strict=True)]) if at else np.zeros(0)
        return pa.table([asked, keys.take(pa.array(where)), pa.array(score)], names=[*names, "score"])

    return run


def _best(terms: list[tuple], size: int, k: int | None, reach: float, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sums of the best ``k`` documents that may reach ``reach``; all with a term without ``k``. ``counted`` takes the number of documents whose sums were completed."""
    slack = 2 * 10.0**-DIGITS
    sums = np.zeros(size)
    rest = sum(t[0] for t in terms)
    if k is None:
        for _, _, w, ids, part in terms:
            sums[ids] += w * part
        at = np.flatnonzero(sums)
        return at, sums[at]
    left = 0
    for _, _, w, ids, part in terms:
        if rest < reach - slack:
            break
        sums[ids] += w * part
        rest -= w * part.max()
        left += 1
        if size > k and rest < sums.max():
            reach = max(reach, float(np.partition(sums, size - k)[size - k]))
    at = np.flatnonzero((sums > 0) & (sums + rest >= reach - slack))
    own = sums[at]
    for bound, _, w, ids, part in terms[left:]:
        if not len(at):
            break
        place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
        own = own + np.where(ids[place] == at, w * part[place], 0.0)
        rest -= bound
        if len(at) > k:
            reach = max(reach, float(np.partition(own, len(own) - k)[len(own) - k]))
        stay = own + max(rest, 0.0) >= reach - slack
        at, own = at[stay], own[stay]
    if counted is not None:
        counted.append(len(at))
    rounded = np.rint(own * 10**DIGITS)
    order = np.lexsort((at, -rounded))[:k]
    return at[order], own[order]


def terms_asked(questions: DataFrame, qid: str, arrays: dict[str, Column]) -> DataFrame:
    """``qid, field, term, share`` of each question's distinct terms by field."""
    parts = [questions.select(qid, F.lit(name).alias("field"), F.explode(F.array_distinct(terms)).alias("term"), F.lit(1.0).alias("share")) for name, terms in arrays.items()]
    return reduce(DataFrame.unionByName, parts)
